"""Base classes for detectors, writers and parsers of one's own."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


class Detector(ABC):
    """DataFrame in, DataFrame out; use with ``df.transform(detector.fit_transform)``."""

    required = ("message", "level", "timestamp")

    def initialize(self, config: dict[str, Any]) -> None:
        """Take settings before the first use."""

    def check(self, df: DataFrame) -> None:
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing: {', '.join(missing)}")

    def fit(self, df: DataFrame) -> "Detector":
        return self

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame:
        """Rows plus ``is_anomaly`` and ``anomaly_score``."""

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self.check(df)
        return self.fit(df).transform(df)

    def feature_importance(self) -> dict[str, float]:
        return {}

    def cleanup(self) -> None:
        """Release what ``initialize`` acquired."""


class Writer(ABC):
    """Writes a frame below a path with Spark writers."""

    file_extension = ""

    @abstractmethod
    def write(self, df: DataFrame, path: str, **options: Any) -> None: ...


class LineParser(ABC):
    """Lines of an odd format, parsed in Arrow batches with a schema known beforehand."""

    supported_formats: tuple[str, ...] = ()
    schema: StructType

    @abstractmethod
    def parse_line(self, line: str) -> dict[str, Any] | None:
        """Fields of a line, or nothing if the line has another shape."""

    def can_parse(self, lines: DataFrame, first: int = 5) -> bool:
        """Whether the first non-blank lines of every source parse."""
        sample = lines.where(F.trim("line") != "").orderBy("line_number").limit(first).collect()
        return bool(sample) and all(self.parse_line(r["line"]) is not None for r in sample)

    def parse(self, lines: DataFrame) -> DataFrame:
        names = [f.name for f in self.schema.fields]
        keep = [f for f in lines.schema.fields if f.name != "line"]
        kept = [f.name for f in keep]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                parsed = [self.parse_line(line) for line in rows["line"]]
                hit = [p is not None for p in parsed]
                fields = pd.DataFrame([p for p in parsed if p is not None], columns=names)
                yield pd.concat([rows.loc[hit, kept].reset_index(drop=True), fields], axis=1)

        return lines.mapInPandas(run, StructType([*keep, *self.schema.fields]))


def register_parser(spark: SparkSession, name: str, parser: LineParser) -> None:
    """Makes a parser a table function for SQL: ``SELECT f.* FROM lines, LATERAL name(line) AS f``.

    A line the parser does not know, and a null line, gives no row. Columns are those of the parser's schema.
    """
    names = [f.name for f in parser.schema.fields]

    class Parse:
        def eval(self, line: str):
            fields = parser.parse_line(line) if line is not None else None
            if fields is not None:
                yield tuple(fields.get(n) for n in names)

    spark.udtf.register(name, F.udtf(Parse, returnType=parser.schema))


class RowFormat(ABC):
    """A text format of one's own: one line for each row, in files written where the rows are."""

    name: str
    file_extension = "txt"

    def header(self, names: list[str]) -> str | None:
        return None

    @abstractmethod
    def line(self, row: Row) -> str:
        """The line of a row, without its line feed."""


class _Committed(WriterCommitMessage):
    def __init__(self, file: str, rows: int) -> None:
        self.file, self.rows = file, rows


class _FormatWriter(DataSourceWriter):
    """Each task writes one file under a name no other task has; the files of failed attempts are removed at the end."""

    def __init__(self, row_format: RowFormat, schema: StructType, path: str, overwrite: bool) -> None:
        import uuid

        self.row_format, self.names, self.path, self.overwrite = row_format, schema.names, path, overwrite
        self.job = uuid.uuid4().hex

    def _files(self):
        from pyarrow import fs

        uri = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}"
        return fs.FileSystem.from_uri(uri)

    def write(self, iterator: Iterator[Row]) -> _Committed:
        import uuid

        files, folder = self._files()
        files.create_dir(folder, recursive=True)
        name = f"part-{self.job}-{uuid.uuid4().hex}.{self.row_format.file_extension}"
        rows = 0
        with files.open_output_stream(f"{folder}/{name}") as out:
            head = self.row_format.header(self.names)
            if head is not None:
                out.write(f"{head}\n".encode())
            for row in iterator:
                out.write(f"{self.row_format.line(row)}\n".encode())
                rows += 1
        return _Committed(name, rows)

    def _remove(self, keep: set[str], every: bool) -> None:
        from pyarrow import fs

        files, folder = self._files()
        for entry in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            mine = entry.base_name.startswith(f"part-{self.job}-")
            if entry.base_name.startswith("part-") and entry.base_name not in keep and (mine or every):
                files.delete_file(entry.path)

    def commit(self, messages: list[_Committed | None]) -> None:
        self._remove({m.file for m in messages if m is not None}, self.overwrite)

    def abort(self, messages: list[_Committed | None]) -> None:
        self._remove(set(), False)


def register_format(spark: SparkSession, row_format: RowFormat) -> None:
    """Makes a format a data source: ``df.write.format(name).mode("append").save(path)``, also for streams of batches.

    ``overwrite`` removes the part files that were there once the new ones are complete. Paths are folders on
    storage every executor reaches: local or shared ones, or what the file systems of pyarrow open (hdfs, s3, gs).
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return row_format.name

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return _FormatWriter(row_format, schema, self.options["path"], overwrite)

    spark.dataSource.register(Source)

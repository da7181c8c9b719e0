"""Log files as rows: admission, reading and stable line numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from logharbor import constants as K
from logharbor.session import durable

_PATH, _BLOCK = "_metadata.file_path", "_metadata.file_block_start"


def _lines(spark: SparkSession, paths: str | Sequence[str], name_filter: str | None) -> DataFrame:
    reader = spark.read
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.text([paths] if isinstance(paths, str) else list(paths))


def read_log_lines(
    spark: SparkSession, paths: str | Sequence[str], name_filter: str | None = None
) -> DataFrame:
    """Rows ``source, line_number, line`` of files, folders or patterns, also compressed.

    Bytes that are not UTF-8 are replaced. Lines are numbered from 1 in each file, blank
    ones included, although a big file is read in many blocks: lines are numbered inside
    their block and moved by the lines of the blocks before, which are counted in a
    separate light scan. No task handles more than a block.
    """
    raw = _lines(spark, paths, name_filter).select(
        F.col(_PATH).alias("source"), F.col(_BLOCK).alias("block_start"), F.make_valid_utf8("value").alias("line")
    )
    return number_lines(raw)


def number_lines(raw: DataFrame) -> DataFrame:
    """Numbers the rows ``source, block_start, line`` of whole files, in the order in which they are read.

    Also for a micro-batch of followed files, which arrive whole. A row's place in its scan is known without moving it; a
    light scan without the text tells, for each block of a file, how many lines came before and where in the scan it
    begins. That table has a row for each block; the lines meet it where they are read, unless it is too large
    for Spark to broadcast.
    """
    placed = raw.withColumn("_order", F.monotonically_increasing_id())
    counts = placed.groupBy("source", "block_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_first"))
    before = W.partitionBy("source").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    blocks = durable(counts.select("source", "block_start", (offset - F.col("_first") + 1).alias("_shift")))
    return placed.join(blocks, ["source", "block_start"]).select(
        "source", (F.col("_order") + F.col("_shift")).cast("bigint").alias("line_number"), "line"
    )


def lines_from_memory(spark: SparkSession, lines: Sequence[str], source: str = "memory") -> DataFrame:
    """A short list of lines, numbered from 1."""
    rows = [(source, i, line) for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "source string, line_number bigint, line string")


def admission_audit(
    spark: SparkSession,
    paths: str | Sequence[str],
    extensions: Sequence[str] = K.ALLOWED_EXTENSIONS,
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per file: extension, size, verdict and reason. Only file names and sizes
    are listed; the files are not read. A limit of size holds only where one is given."""
    listed = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    suffix = F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1))
    files = listed.select(F.col("path").alias("source"), F.col("length").alias("bytes")).withColumn("extension", suffix)
    reason = F.when(~F.col("extension").isin(*extensions), "extension not allowed").when(
        F.lit(max_bytes is not None) & (F.col("bytes") > F.lit(max_bytes or 0)), "file too large"
    )
    return files.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def read_admitted(
    spark: SparkSession,
    paths: str | Sequence[str],
    extensions: Sequence[str] = K.ALLOWED_EXTENSIONS,
    max_bytes: int | None = None,
) -> DataFrame:
    """Rows ``source, line_number, line`` of the files that pass the audit; the conditions prune files before
    reading. Files of any size are read unless a limit is given."""
    rows = _lines(spark, paths, "*.{" + ",".join(extensions) + "}")
    if max_bytes is not None:
        rows = rows.where(F.col("_metadata.file_size") <= max_bytes)
    return number_lines(rows.select(F.col(_PATH).alias("source"), F.col(_BLOCK).alias("block_start"), F.make_valid_utf8("value").alias("line")))

"""The newest rows of each key, in a batch and kept up to date by a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F



def newest_rows(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str] = ("timestamp", "line_number")) -> DataFrame:
    """At most ``n`` rows of each key, those that come last in ``order``; nulls come first.

    Tasks drop what cannot be among the newest of a key before anything moves, so a key with a third of all
    rows sends ``n`` rows from each task. Where ``order`` does not decide, the choice among equals is any.
    """
    window = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    place = "_place"
    return df.withColumn(place, F.row_number().over(window)).where(F.col(place) <= n).drop(place)


class NewestRows:
    """Batch function that keeps the newest ``n`` rows of each key of a stream.

    The newest rows of two tables are the newest of their newest, so each batch merges its own with those before. A
    batch writes its table to a folder of its own and starts from the last one before it, so a restart goes on where it
    was and a batch that runs again counts once.
    """

    def __init__(self, folder: str, keys: Sequence[str], n: int, order: Sequence[str] = ("timestamp", "line_number")) -> None:
        self.folder, self.keys, self.n, self.order = folder.rstrip("/"), list(keys), n, list(order)

    def _stored(self, spark: SparkSession, before: int | None = None) -> str | None:
        """The folder of the last batch, or of the last one before a given batch."""
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        numbers = [int(x.removeprefix("after-")) for x in names if x.startswith("after-") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{x}/_SUCCESS"))]
        numbers = [x for x in numbers if before is None or x < before]
        return f"{self.folder}/after-{max(numbers)}" if numbers else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = self._stored(spark, number)
        rows = newest_rows(batch, self.keys, self.n, self.order)
        if earlier:
            rows = newest_rows(rows.unionByName(spark.read.schema(batch.schema).parquet(earlier)), self.keys, self.n, self.order)
        rows.write.mode("overwrite").parquet(f"{self.folder}/after-{number}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The newest rows so far."""
        stored = self._stored(spark)
        if stored is None:
            raise ValueError("no batch has ended yet")
        return spark.read.parquet(stored)

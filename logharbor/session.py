"""Session settings and places on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "logharbor", **conf: str) -> SparkSession:
    """A session with the settings the jobs assume. On a cluster the master comes from submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="logharbor-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def _application_dir(spark: SparkSession) -> str:
    return f"{_checkpoint_root(spark).rstrip('/')}/logharbor/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, for tables and streaming state."""
    return f"{_application_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage as Parquet and go on from the written rows.

    Used where a plan reads the same rows twice and must see the same values both
    times (range partitions, iterations); survives the loss of executors. Later steps
    read only the columns they need. The order of rows is not kept. What the plan of ``df`` has shuffled is removed once
    its rows are stored, so the disk of a chain of steps is that of its largest step.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "rows")
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove rows that ``durable`` stored and no later step reads; only such rows of this application go."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm, own = spark.sparkContext._jvm, _application_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in folders:
        if f"{own}/rows-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle and sort, however small Spark takes it for.

    Stored rows count by the size of their files. Repeated values and arrays shrink to a
    hundredth there, and what is made of such rows would be broadcast through the driver.
    """
    return df.hint("merge")


def partitions_for(n: int, spark: SparkSession, rows: int) -> int:
    """How many partitions give a task about ``rows`` of ``n`` rows; at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-n // rows))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Stored rows dealt out so that a task holds about ``rows`` of them.

    Files are read in pieces by their bytes, which say little about what a task makes of the rows.
    """
    n = df.count()
    return df if n <= rows else df.repartition(partitions_for(n, df.sparkSession, rows))


def clear_shared(spark: SparkSession) -> None:
    """Remove what this application wrote to the shared folder; call it when all results are consumed."""
    jvm, path = spark.sparkContext._jvm, _application_dir(spark)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

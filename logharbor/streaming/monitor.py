"""Live logs with Structured Streaming: read, score, count, alert, throttle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logharbor.config import AlertConfig
from logharbor.functions.ordering import micros_between
from logharbor.operators.parsing import LogParser
from logharbor.operators.report import flagged, rows_counted
from logharbor.operators.service import rate_limit
from logharbor.session import durable
from logharbor.sources.text import number_lines

Deliver = Callable[[DataFrame, int], None]


def follow_directory(
    spark: SparkSession, path: str, name_filter: str = "*", files_per_trigger: int = 100
) -> DataFrame:
    """New files below ``path`` as rows (source, block_start, line). Rotated files arrive whole;
    how many are taken at once is bounded, what waits stays on storage and none is dropped."""
    lines = (
        spark.readStream.option("pathGlobFilter", name_filter)
        .option("maxFilesPerTrigger", files_per_trigger)
        .text(path)
    )
    return lines.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.make_valid_utf8("value").alias("line"),
    )


def numbered_batches(
    write_batch: Callable[[DataFrame, int], None], parser: LogParser | None = None
) -> Callable[[DataFrame, int], None]:
    """Batch function for followed files: numbers the lines of each file, parses them and hands the
    log rows on, so that detectors that work by line see what they see in a batch job."""
    chosen = parser or LogParser()

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write_batch(chosen.parse(number_lines(batch)), number)

    return write


def parsed_stream(lines: DataFrame, parser: LogParser | None = None) -> DataFrame:
    return (parser or LogParser()).parse(lines)


def start(
    stream: DataFrame,
    write_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Run ``write_batch`` per micro-batch. Without an interval everything that is there
    is processed and the query ends, which is also how a stream is drained on shutdown."""
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write_batch)
    )
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


# --- scoring -----------------------------------------------------------------------

def scoring_batches(
    detect: Callable[[DataFrame], DataFrame], output: str, deliver: Deliver | None = None
) -> Callable[[DataFrame, int], None]:
    """Batch function that scores rows, keeps them in a table and hands on the flagged ones.

    ``detect`` is a stored model's ``transform`` or a function that fits on the batch. A
    batch writes to its own folder, so one that runs again replaces its earlier output.
    """

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        folder = f"{output}/batch={number}"
        detect(batch).write.mode("overwrite").parquet(folder)
        if deliver is not None:
            found = batch.sparkSession.read.parquet(folder).where(flagged())
            if not found.isEmpty():
                deliver(found, number)

    return write


class LatestRowsModel:
    """Scores each batch with the model so far, then refits on the latest ``keep`` rows.

    The latest rows after each batch live in a small table of that batch on shared storage; the
    model is what ``fit`` makes of the table of the batch before. So a restart goes on with the
    same model, and a batch that runs again learns nothing twice. Before ``keep`` rows have been
    seen every row is normal.
    """

    def __init__(
        self, fit: Callable[[DataFrame], object], folder: str, keep: int = 100, order: tuple[str, ...] = ("timestamp", "line_number"),
    ) -> None:
        self.fit, self.folder, self.keep, self.order = fit, folder.rstrip("/"), keep, order
        self._known: tuple[int, object] | None = None

    def _stored(self, spark: SparkSession, before: int) -> int | None:
        """The last batch before the given one whose rows are stored."""
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        done = [int(n.removeprefix("after-")) for n in names if n.startswith("after-") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return max((n for n in done if n < before), default=None)

    def model_before(self, spark: SparkSession, number: int) -> tuple[DataFrame | None, object]:
        """The latest rows and the model a batch starts from."""
        last = self._stored(spark, number)
        if last is None:
            return None, None
        rows = spark.read.parquet(f"{self.folder}/after-{last}")
        if self._known is None or self._known[0] != last:
            self._known = (last, self.fit(rows) if rows.count() >= self.keep else None)
        return rows, self._known[1]

    def score_and_learn(self, batch: DataFrame, number: int, output: str) -> None:
        rows, model = self.model_before(batch.sparkSession, number)
        if model is None:
            scored = batch.withColumn("anomaly_score", F.lit(0.0)).withColumn("is_anomaly", F.lit(0))
        else:
            scored = model.transform(batch)
        scored.write.mode("overwrite").parquet(f"{output}/batch={number}")
        seen = batch if rows is None else batch.unionByName(rows)
        # A top-k of ``keep`` rows, not a sort of the batch.
        newest = seen.orderBy(*[F.desc(c) for c in self.order]).limit(self.keep)
        newest.write.mode("overwrite").parquet(f"{self.folder}/after-{number}")

    def batches(self, output: str) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, number: int) -> None:
            if not batch.isEmpty():
                self.score_and_learn(batch, number, output)

        return write


# --- windows, throttling, limits ------------------------------------------------------

def with_event_time(stream: DataFrame, ts: str = "timestamp", delay: str = "10 minutes") -> DataFrame:
    """Watermarks need a timestamp with zone; the session zone is UTC."""
    return stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)


def windowed_alerts(
    detected: DataFrame, config: AlertConfig = AlertConfig(), ts: str = "timestamp", delay: str = "10 minutes"
) -> DataFrame:
    """Flagged rows per source and window, where there are enough of them. In append mode
    a window is reported once, when the watermark has passed it."""
    window = F.window("event_time", f"{config.time_window_minutes} minutes")
    return (
        with_event_time(detected.where(flagged()), ts, delay)
        .groupBy("source", window.alias("w"))
        .agg(rows_counted().alias("count"))
        .where(F.col("count") >= config.anomaly_threshold)
        .select("source", F.col("w.start").alias("window_start"), "count")
    )


def throttled_alerts(candidates: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """Candidates (source, window_start, count) that are sent; the state of a source is
    the time of its last sent alert. Candidates of one batch are taken in time order."""
    pause = pd.Timedelta(minutes=config.throttle_minutes)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(batches).sort_values("window_start")
        sent = []
        for at in rows["window_start"]:
            at = pd.Timestamp(at).tz_localize(None)
            fresh = last is None or at >= last + pause
            last = at if fresh else last
            sent.append(fresh)
        state.update((last.value // 1000,))
        yield rows[sent]

    return candidates.groupBy("source").applyInPandasWithState(
        decide, "source string, window_start timestamp, count bigint", "last_sent bigint", "append",
        GroupStateTimeout.NoTimeout,
    )


class RateLimitBatches:
    """Batch function that decides which requests of a stream are allowed.

    A batch is decided by the distributed ``rate_limit`` together with the state: the
    allowed requests inside the last window of each client, at most ``max_requests`` per
    client, kept in one small table per batch. A batch that runs again starts from the
    same state and replaces its output.
    """

    def __init__(self, output: str, state: str, max_requests: int = 100, window_seconds: int = 60) -> None:
        self.output, self.state = output, state
        self.max_requests, self.window_seconds = max_requests, window_seconds

    def _carried(self, spark: SparkSession, number: int) -> DataFrame | None:
        try:
            states = spark.read.parquet(self.state).where(F.col("batch") < number)
        except AnalysisException:
            return None
        latest = states.agg(F.max("batch")).first()[0]
        return None if latest is None else states.where(F.col("batch") == latest).drop("batch")

    def __call__(self, batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        carried = self._carried(batch.sparkSession, number)
        rows = batch.withColumn("carried", F.lit(False))
        if carried is not None:
            rows = rows.unionByName(carried.withColumn("carried", F.lit(True)))
        decided = durable(rate_limit(rows, self.max_requests, self.window_seconds))
        decided.where(~F.col("carried")).drop("carried").write.mode("overwrite").parquet(
            f"{self.output}/batch={number}"
        )
        ends = decided.groupBy("client_id").agg(F.max("ts").alias("last"))
        inside = micros_between(F.col("ts"), F.col("last")) < self.window_seconds * 1_000_000
        kept = decided.where("allowed").join(ends, "client_id").where(inside)
        kept.select(*batch.columns).write.mode("overwrite").parquet(f"{self.state}/batch={number}")


def rolling_service_levels(requests: DataFrame, length: str = "24 hours", step: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Availability and mean response time per sliding window."""
    return (
        with_event_time(requests, "ts", delay)
        .groupBy(F.window("event_time", length, step).alias("w"))
        .agg(
            rows_counted().alias("requests"),
            F.count_if(~F.col("success")).alias("errors"),
            F.avg("response_time").alias("response_time_avg"),
        )
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "errors",
            ((F.col("requests") - F.col("errors")) * 100.0 / F.col("requests")).alias("availability"),
            "response_time_avg",
        )
    )


def counted(stream: DataFrame, name: str = "detection") -> DataFrame:
    """Attaches live counters; they show up in ``query.lastProgress['observedMetrics']``."""
    return stream.observe(
        name, rows_counted().alias("processed"), F.count_if(flagged()).alias("anomalies")
    )


def latest_update(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Newest version of each key in a table written batch by batch in update mode."""
    rows = spark.read.parquet(folder)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


def upserting_batches(folder: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write

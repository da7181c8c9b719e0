"""Live alerts in one stateful operator: windows of flagged rows, first messages, throttle and a flush at the end.

Tasks first shrink their flagged rows to one row for each source and window (count and first messages), so a source
with a third of all rows sends a few rows. The state of a source holds its open windows and the time of its last
alert; an event-time timer closes windows when the watermark has passed them, in order, and decides on the spot whether an
alert is sent or held back by the throttle.

A drained stream leaves windows open that the watermark has not reached. ``Flush`` ends them: a marker row in a control
folder, later than every open window, moves the watermark when the query runs once more.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logharbor.config import AlertConfig
from logharbor.operators.report import flagged
from logharbor.session import shared_dir

_PARTIAL = "source string, window_start long, event_time timestamp, count long, firsts string"
_ALERT = "source string, window_start timestamp, count bigint, messages array<string>"
_SAMPLE = 5


def _merged(a: list, b: list) -> list:
    """The first messages of two lists of [time, line, message], by time and line."""
    return sorted([*a, *b], key=lambda m: (m[0], m[1]))[:_SAMPLE]


def _partials(width: int):
    """One row for each source and window of a batch; ``event_time`` is the last time in it."""

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows[rows["micros"].notna()]
            rows = rows.assign(window_start=rows["micros"] // width * width).sort_values(["micros", "line_number"])
            out = []
            for (source, start), some in rows.groupby(["source", "window_start"], dropna=False, sort=False):
                head = some.head(_SAMPLE)
                firsts = [[int(t), int(n), m or ""] for t, n, m in zip(head["micros"], head["line_number"], head["message"])]
                out.append((source if isinstance(source, str) else None, int(start), pd.Timestamp(int(some["micros"].iloc[-1]), unit="us", tz="UTC"), len(some), json.dumps(firsts)))
            yield pd.DataFrame(out, columns=["source", "window_start", "event_time", "count", "firsts"])

    return shrink


def live_alerts(
    detected: DataFrame, config: AlertConfig = AlertConfig(), ts: str = "timestamp", delay: str = "10 minutes", control: DataFrame | None = None
) -> DataFrame:
    """``source, window_start, count, messages`` of the alerts that are sent, from a stream of rows with ``is_anomaly``.

    A window of ``time_window_minutes`` with at least ``anomaly_threshold`` flagged rows of a source is a candidate; it is
    sent unless an alert of the source was sent less than ``throttle_minutes`` before it. ``messages`` are its first five,
    by time and line. Rows without a time belong to no window. Rows for a window that was closed already come too late
    and are left out.
    """
    width = config.time_window_minutes * 60_000_000
    pause = config.throttle_minutes * 60_000_000
    line = F.col("line_number").cast("long") if "line_number" in detected.columns else F.lit(0).cast("long")
    rows = detected.where(flagged()).select(
        F.col("source").cast("string").alias("source"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"),
        F.coalesce(line, F.lit(0)).alias("line_number"), F.col("message").cast("string").alias("message"),
    )
    partial = rows.mapInPandas(_partials(width), _PARTIAL)
    if control is not None:
        partial = partial.unionByName(control)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"last": None, "windows": {}}
        windows, now = held["windows"], state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            for start, count, firsts in zip(batch["window_start"], batch["count"], batch["firsts"]):
                if count and int(start) + width > now:
                    seen, known = windows.get(str(start), (0, []))
                    windows[str(start)] = (seen + int(count), _merged(known, json.loads(firsts)))
        closed = sorted(int(s) for s in windows if int(s) + width <= now)
        sent = []
        for start in closed:
            count, firsts = windows.pop(str(start))
            if count >= config.anomaly_threshold and (held["last"] is None or start >= held["last"] + pause):
                held["last"] = start
                sent.append((key[0], pd.Timestamp(start, unit="us"), count, [m[2] for m in firsts]))
        # With no window open, the time from which the last alert can hold no window back any more.
        free = (held["last"] or 0) + pause + width
        if windows or held["last"] is not None and free > now:
            state.update((json.dumps(held),))
            next_ = min(int(s) for s in windows) + width if windows else free
            state.setTimeoutTimestamp(max(next_ // 1000, now // 1000 + 1))
        elif state.exists:
            state.remove()
        if sent:
            yield pd.DataFrame(sent, columns=["source", "window_start", "count", "messages"])

    return partial.withWatermark("event_time", delay).groupBy("source").applyInPandasWithState(
        step, _ALERT, "held string", "append", GroupStateTimeout.EventTimeTimeout
    )


class Flush:
    """A control folder whose marker rows end all open windows of ``live_alerts``."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or shared_dir(spark, "control")
        # The folder has to be there before a stream reads it.
        spark.createDataFrame([], _PARTIAL).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(_PARTIAL).parquet(self.folder)

    def mark(self, watermark: str, config: AlertConfig, delay_minutes: int = 10) -> None:
        """Adds a marker later than every window open at ``watermark`` (ISO, as a query's progress gives it)."""
        ahead = 2 * delay_minutes + config.time_window_minutes + 1
        at = F.lit(watermark).cast("timestamp") + F.make_dt_interval(mins=F.lit(ahead))
        row = self.spark.range(1).select(
            F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("window_start"), at.alias("event_time"),
            F.lit(0).cast("long").alias("count"), F.lit("[]").alias("firsts"),
        )
        row.coalesce(1).write.mode("append").parquet(self.folder)


def drain_and_flush(start: Callable[[], StreamingQuery], flush: Flush, config: AlertConfig, delay_minutes: int = 10) -> None:
    """Runs a query over what is there, then once more with a marker, so nothing stays open.

    ``start`` starts the query, each time with the same checkpoint, until everything that is there is processed. Rows
    that come afterwards with times before the marker are late.
    """
    query = start()
    query.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if p["eventTime"].get("watermark")]
    known = max((m for m in marks if not m.startswith("1970")), default=None)
    # A run that found nothing new tells no watermark; then the clock ends whatever is open.
    flush.mark(known or dt.datetime.now(dt.timezone.utc).isoformat(), config, delay_minutes)
    start().awaitTermination()

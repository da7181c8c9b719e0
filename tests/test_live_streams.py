"""Live alerts, delivery and rolling levels over several batches, restarts and a flush at the end."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logharbor.config import AlertConfig
from logharbor.streaming import monitor as M
from logharbor.streaming.live_alerts import Flush, drain_and_flush, live_alerts
from logharbor.streaming.outbox import Outbox
from logharbor.streaming.service_levels import rolling_levels

_CONFIG = AlertConfig(anomaly_threshold=3, time_window_minutes=5, throttle_minutes=15)
_SCHEMA = "source string, line_number long, timestamp timestamp_ntz, message string, is_anomaly int"
_T0 = dt.datetime(2024, 5, 1)


def _expected(rows):
    windows = {}
    for source, line, at, message, flag in rows:
        if flag == 1 and at is not None:
            start = at - (at - dt.datetime(1970, 1, 1)) % dt.timedelta(minutes=5)
            windows.setdefault((source, start), []).append((at, line, message or ""))
    last, out = {}, []
    for (source, start), held in sorted(windows.items(), key=lambda w: (w[0][0] or "", w[0][1])):
        if len(held) >= 3 and (source not in last or start >= last[source] + dt.timedelta(minutes=15)):
            last[source] = start
            out.append((source, start, len(held), [m for _, _, m in sorted(held, key=lambda h: h[:2])[:5]]))
    return out


def _rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        at = _T0 + dt.timedelta(seconds=i * 11 + rng.randrange(-200, 200))  # out of order by less than the delay
        rows.append((rng.choice(["a", "a", "b", None]), i, at, rng.choice([None, f"m{i}"]), int(rng.random() < 0.4)))
    return rows + [("a", 901, None, "no time", 1)]


def test_alerts_over_batches_with_flush(spark, tmp_path):
    rows = _rows(1)
    folder, progress, out = (str(tmp_path / n) for n in ("in", "progress", "out"))
    flush = Flush(spark, str(tmp_path / "control"))
    spark.createDataFrame(rows[:0], _SCHEMA).write.parquet(folder)

    def start():
        stream = spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        return M.start(live_alerts(stream, _CONFIG, control=flush.stream()), M.upserting_batches(out), progress)

    for low in range(0, len(rows), 300):
        spark.createDataFrame(rows[low : low + 300], _SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        if low < 600:
            start().awaitTermination()  # a restart goes on from the stored windows
    before = spark.read.parquet(out).count()
    drain_and_flush(start, flush, _CONFIG)
    found = spark.read.parquet(out).orderBy(F.coalesce("source", F.lit("")), "window_start").collect()
    got = [(r["source"], r["window_start"].replace(tzinfo=None), r["count"], r["messages"]) for r in found]
    assert got == _expected(rows) and before < len(got)


def test_outbox_delivers_once_after_failures_and_restarts(spark, tmp_path):
    sent, broken = [], [True]

    def send(rows):
        if broken[0]:
            raise ConnectionError("no route")
        sent.extend((r["source"], r["n"]) for r in rows.collect())

    first, second = (spark.createDataFrame([(s, i, i) for s, i in rows], "source string, window_start long, n int") for rows in ([("a", 1), ("b", 1)], [("a", 2)]))
    box = Outbox(str(tmp_path), send)
    assert box.pending(spark) is None
    box.put(first, 0)
    assert sent == [] and len(box.failures) == 1
    with pytest.raises(ConnectionError):
        Outbox(str(tmp_path), send, stop_on_failure=True).put(first, 0)
    broken[0] = False
    again = Outbox(str(tmp_path), send)  # another process
    again.put(second, 1)
    assert sorted(sent) == [("a", 1), ("a", 2), ("b", 1)]
    again.put(second, 1)  # a batch that runs again
    again.put(first, 2)  # the same alerts in a later batch
    assert again.deliver(spark) == 0 and len(sent) == 3


def test_rolling_levels_against_sorted_lists(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.choice([None, 0.5, 0.5, rng.random() * 9, float(rng.randrange(4))]), rng.random() < 0.9) for _ in range(3000)]
    rows += [(70, None, True)]
    hour = lambda h: F.lit(_T0).cast("timestamp") + F.make_dt_interval(hours=h)
    df = spark.createDataFrame(rows, "h int, response_time double, success boolean").withColumn("hour", hour(F.col("h")))
    counts = df.groupBy("hour", "response_time").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("success")).alias("errors"))
    got = {r["window_start"]: r for r in rolling_levels(counts, 6).collect()}
    base = df.select(hour(F.lit(0))).first()[0]
    expected = {base + dt.timedelta(hours=s) for h, _, _ in rows for s in range(h - 5, h + 1)}
    assert got.keys() == expected
    for s in (-5, -2, 0, 17, 54, 59, 65, 70):
        inside = [r for r in rows if s <= r[0] < s + 6]
        times, row = sorted(t for _, t, _ in inside if t is not None), got[base + dt.timedelta(hours=s)]
        want = [times[int(len(times) * q)] if times else 0.0 for q in (0.5, 0.95, 0.99)]
        assert [row["response_time_p50"], row["response_time_p95"], row["response_time_p99"]] == want
        assert row["requests"] == len(inside) and row["errors"] == sum(not ok for _, _, ok in inside)
        assert row["response_time_ok"] == (want[1] <= 5.0)
    assert rolling_levels(counts.limit(0)).count() == 0


def test_newest_rows_survive_repeats_and_restarts(spark, tmp_path):
    from logharbor.streaming.newest import NewestRows, newest_rows

    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", None, "b"]), i, rng.choice([None, i % 50]), f"m{i}") for i in range(400)]
    schema = "source string, line_number long, timestamp long, message string"
    whole = spark.createDataFrame(rows, schema)
    expected = sorted(map(str, newest_rows(whole, ["source"], 7).collect()))
    plain = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1]), reverse=True):
        plain.setdefault(r[0], []).append(r[1])
    assert len(expected) == sum(min(7, len(v)) for v in plain.values())
    assert {r["line_number"] for r in newest_rows(whole, ["source"], 7).collect()} == {i for v in plain.values() for i in v[:7]}
    for number, low in enumerate(range(0, 400, 100)):
        batch = spark.createDataFrame(rows[low : low + 100], schema)
        keep = NewestRows(str(tmp_path), ["source"], 7)  # a new process each time
        keep(batch, number)
        keep(batch, number)  # and each batch twice
    assert sorted(map(str, keep.rows(spark).collect())) == expected
    with pytest.raises(ValueError):
        NewestRows(str(tmp_path / "none"), ["source"], 7).rows(spark)

"""Service levels, metric status and rate limits over a table of requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logharbor import constants as K
from logharbor.functions.ordering import epoch_micros, hour_start, salted_lookup, trailing_counts
from logharbor.functions.stats import kth_smallest
from logharbor.operators.report import rows_counted
from logharbor.session import durable


def hourly_requests(requests: DataFrame) -> DataFrame:
    return requests.groupBy(hour_start(F.col("ts")).alias("hour")).agg(
        rows_counted().alias("requests"), F.count_if(~F.col("success")).alias("errors")
    )


def sla_metrics(
    requests: DataFrame,
    as_of: Column,
    hours: int = 24,
    targets: dict[str, float] = K.SLA_TARGETS,
) -> DataFrame:
    """Availability, error rate and response times over the hours before ``as_of``.

    Requests and errors count by whole hours that start inside the window. Response times
    are those of all requests of the window; percentile q is the element at position
    floor(n·q) of the sorted times, without interpolation, found exactly without sorting
    all of them.
    """
    start = as_of - F.expr(f"INTERVAL {hours} HOURS")
    recent = hourly_requests(requests).where(F.col("hour") >= start)
    totals = recent.agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
    )
    zero = F.lit(0.0)
    times = requests.where((F.col("ts") >= start) & (F.col("ts") <= as_of) & F.col("response_time").isNotNull())
    counted = times.agg(F.count(F.lit(1)).alias("n"), F.avg("response_time").alias("mean")).first()
    at = lambda q: kth_smallest(times, "response_time", int(counted["n"] * q) + 1) if counted["n"] else 0.0
    response = {f"response_time_p{round(q * 100)}": at(q) for q in (0.5, 0.95, 0.99)}
    response["response_time_avg"] = counted["mean"] or 0.0
    total = F.col("requests")
    rates = totals.select(
        F.when(total > 0, (total - F.col("errors")) * 100.0 / total).otherwise(F.lit(100.0)).alias("availability"),
        F.when(total > 0, F.col("errors") * 100.0 / total).otherwise(zero).alias("error_rate"),
    )
    return rates.select("*", *[F.lit(float(v)).alias(c) for c, v in response.items()]).select(
        "*",
        (F.col("availability") >= targets["availability"]).alias("availability_ok"),
        (F.col("response_time_p95") <= targets["response_time_p95"]).alias("response_time_ok"),
        (F.col("error_rate") <= targets["error_rate"]).alias("error_rate_ok"),
    )


def metric_status(metrics: DataFrame, thresholds: dict[str, tuple[float, float]] = K.METRIC_THRESHOLDS) -> DataFrame:
    """Status of each (time, metric, value) row; ``overall`` is the worst one at that time."""
    value = F.col("value")
    rank = F.lit(0)
    for name, (warn, bad) in thresholds.items():
        at = F.col("metric") == name
        rank = F.when(at & (value > bad), 2).when(at & (value > warn), 1).otherwise(rank)
    names = F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy"))
    rows = metrics.withColumn("_rank", rank)
    worst = rows.groupBy("time").agg(F.max("_rank").alias("_worst"))
    return rows.join(worst, "time").select(
        "time", "metric", "value",
        F.get(names, F.col("_rank")).alias("status"),
        F.get(names, F.col("_worst")).alias("overall"),
    )


def rate_limit(
    requests: DataFrame, max_requests: int = 100, window_seconds: int = 60
) -> DataFrame:
    """Adds ``allowed``: fewer than ``max_requests`` allowed ones in the window before.

    A request with at most ``max_requests`` requests in its window, itself included, is
    allowed whatever happened earlier. Only crowded requests, and the window before each
    of them, need the order of events. Those rows fall into segments wherever a pause as
    long as the window has emptied the state; segments are distributed, and inside one
    the rows stream in time order with the last allowed times as the only state.
    """
    window = window_seconds * 1_000_000
    # One slim row per client and distinct time, read several times below.
    load = durable(trailing_counts(requests, "ts", window_seconds, "_load", ["client_id"]))
    segments = durable(_segments(durable(_near_crowded(load, max_requests, window)), window))
    times = load.select("client_id", "ts", "n").join(segments, ["client_id", "ts"], "left")
    rows = salted_lookup(requests, times, ["client_id", "ts"], "n", ["request_id"])
    free = rows.where(F.col("_segment").isNull()).select(*requests.columns, F.lit(True).alias("allowed"))
    schema = free.schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, deque()
        for batch in batches:
            allowed = []
            for client, segment, us in zip(batch["client_id"], batch["_segment"], batch["_us"]):
                if (client, segment) != key:
                    key, kept = (client, segment), deque()
                while kept and us - kept[0] >= window:
                    kept.popleft()
                allowed.append(len(kept) < max_requests)
                if allowed[-1]:
                    kept.append(us)
            yield batch.assign(allowed=allowed)[schema.names]

    decided = (
        rows.where(F.col("_segment").isNotNull())
        .withColumn("_us", epoch_micros(F.col("ts")))
        .repartition("client_id", "_segment")
        .sortWithinPartitions("client_id", "_segment", "_us", "request_id")
        .mapInPandas(fold, schema)
    )
    return free.unionByName(decided)


def _near_crowded(load: DataFrame, max_requests: int, window: int) -> DataFrame:
    """Distinct request times that are crowded or have a crowded one within the window after."""
    marked = load.withColumn("_us", epoch_micros(F.col("ts"))).withColumn(
        "_crowded", (F.col("_load") > max_requests).cast("int")
    )
    bucket_of = lambda micros: F.floor(micros / F.lit(window))
    copied = marked.withColumn(
        "_bucket", F.explode(F.sequence(bucket_of(F.col("_us") - window), bucket_of(F.col("_us"))))
    )
    # The next crowded time is a running minimum from the end; a frame of its own for each row would be
    # searched anew each time.
    onwards = W.partitionBy("client_id", "_bucket").orderBy(F.desc("_us")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        copied.withColumn("_next", F.min(F.when(F.col("_crowded") == 1, F.col("_us"))).over(onwards))
        .where((F.col("_bucket") == bucket_of(F.col("_us"))) & (F.col("_next") - F.col("_us") <= window))
        .select("client_id", "ts", "_us")
    )


def _segments(times: DataFrame, window: int, windows_per_block: int = 1000) -> DataFrame:
    """Number the runs of times that are closer than the window, block by block.

    A block covers a fixed span of time. Times after the first pause inside a block get
    the block's own number; the ones before it belong to the last earlier block with a
    pause, looked up in a table with one row per client and block.
    """
    keyed = times.withColumn("_block", F.floor(F.col("_us") / F.lit(window * windows_per_block)))
    in_block = W.partitionBy("client_id", "_block").orderBy("_us")
    by_client = W.partitionBy("client_id").orderBy("_block")
    ends = keyed.groupBy("client_id", "_block").agg(F.max("_us").alias("_last"))
    carried = ends.select("client_id", "_block", F.lag("_last").over(by_client).alias("_carry"))
    before = F.coalesce(F.lag("_us").over(in_block), F.col("_carry"))
    gaps = keyed.join(carried, ["client_id", "_block"]).withColumn("_before", before)
    resets = gaps.withColumn(
        "_reset", F.col("_before").isNull() | (F.col("_us") - F.col("_before") >= window)
    )
    firsts = resets.groupBy("client_id", "_block").agg(
        F.min(F.when(F.col("_reset"), F.col("_us"))).alias("_first")
    )
    earlier = by_client.rowsBetween(W.unboundedPreceding, -1)
    anchored = firsts.withColumn(
        "_anchor",
        F.last(F.when(F.col("_first").isNotNull(), F.col("_block")), ignorenulls=True).over(earlier),
    )
    return resets.join(anchored, ["client_id", "_block"]).select(
        "client_id", "ts",
        F.when(F.col("_us") >= F.col("_first"), F.col("_block"))
        .otherwise(F.col("_anchor")).alias("_segment"),
    )

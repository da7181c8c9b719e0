"""Rolling service levels with exact percentiles from counts of values that can be added up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from logharbor import constants as K
from logharbor.session import durable

_BINS = 256
_QUANTILES = (0.5, 0.95, 0.99)


def hourly_value_counts(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``hour, response_time, requests, errors``: how often each response time occurs in an hour, a stream in update mode.

    Counts of hours add up to counts of any window of hours, so percentiles need no samples and no sketch.
    """
    timed = requests.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    return (
        timed.groupBy(F.window("event_time", "1 hour").alias("w"), "response_time")
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("success")).alias("errors"))
        .select(F.col("w.start").alias("hour"), "response_time", "requests", "errors")
    )


def _total():
    """Sum of all response times, exact to nine decimals while they are below 10^15, so its order does not matter."""
    exact = F.sum(F.col("response_time").try_cast("decimal(24,9)") * F.col("requests").cast("decimal(10,0)")).cast("double")
    rough = F.sum(F.col("response_time") * F.col("requests"))
    return F.when(F.max(F.abs("response_time")) < 1e15, exact).otherwise(rough)


def rolling_levels(counts: DataFrame, hours: int = 24, targets: dict[str, float] = K.SLA_TARGETS) -> DataFrame:
    """Levels of every window of ``hours`` hours that holds a request, one window for each hour, from hourly counts.

    Percentile q is the element at position floor(n q) of the sorted response times of a window. Values are cut into at
    most 256 bins of about equal counts: a window's bins say which one holds the position, and only the values of
    that bin are sorted. Requests without a response time count, but not for percentiles.
    """
    back = F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))
    spread = counts.withColumn("_back", back).withColumn("window_start", F.col("hour") - F.make_dt_interval(hours=F.col("_back")))
    totals = spread.groupBy("window_start").agg(
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"),
        F.sum(F.when(F.col("response_time").isNotNull(), F.col("requests"))).alias("timed"),
        (_total() / F.sum(F.when(F.col("response_time").isNotNull(), F.col("requests")))).alias("response_time_avg"),
    )
    totals = durable(totals)
    timed = counts.where("response_time IS NOT NULL AND NOT isnan(response_time)")
    edges = timed.agg(F.percentile_approx("response_time", F.array(*[F.lit(i / _BINS) for i in range(1, _BINS)]), F.lit(2000)).alias("e")).first()["e"]
    # Splitters are values, so equal values share a bin; they decide the work, not the result.
    cuts = F.array(*[F.lit(float(e)) for e in sorted(set(edges or []))]).cast("array<double>")
    binned = timed.withColumn("bin", F.aggregate(cuts, F.lit(0), lambda n, e: n + (e < F.col("response_time")).cast("int")))
    window_of = F.col("hour") - F.make_dt_interval(hours=F.col("_back"))
    values = binned.groupBy("hour", "bin", "response_time").agg(F.sum("requests").alias("n"))
    values = durable(values.withColumn("_back", back).groupBy(window_of.alias("window_start"), "bin", "response_time").agg(F.sum("n").alias("n")))
    bins = values.groupBy("window_start", "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("window_start").orderBy("bin"))  # at most 256 bins
    ranks = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.floor(F.col("timed") * q).alias("rank")) for q in _QUANTILES]))
    wanted = totals.select("window_start", ranks.alias("r")).select("window_start", "r.q", "r.rank")
    placed = bins.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n")).drop("n")
    holding = placed.join(wanted, "window_start").where("before <= rank AND rank < upto").select("window_start", "bin", "q", "rank", "before")
    inside = values.join(holding, ["window_start", "bin"])
    order = W.partitionBy("window_start", "q").orderBy("response_time")
    reached = F.col("before") + F.sum("n").over(order)
    found = inside.withColumn("reached", reached).where("reached > rank").groupBy("window_start", "q").agg(F.min("response_time").alias("v"))
    wide = found.groupBy("window_start").agg(
        *[F.max(F.when(F.col("q") == q, F.col("v"))).alias(f"response_time_p{round(q * 100)}") for q in _QUANTILES]
    )
    n, errors = F.col("requests"), F.col("errors")
    levels = totals.join(wide, "window_start", "left").select(
        "window_start", (F.col("window_start") + F.make_dt_interval(hours=F.lit(hours))).alias("window_end"), "requests", "errors",
        ((n - errors) * 100.0 / n).alias("availability"), (errors * 100.0 / n).alias("error_rate"),
        *[F.coalesce(f"response_time_p{round(q * 100)}", F.lit(0.0)).alias(f"response_time_p{round(q * 100)}") for q in _QUANTILES],
        F.coalesce("response_time_avg", F.lit(0.0)).alias("response_time_avg"),
    )
    return levels.select(
        "*",
        (F.col("availability") >= targets["availability"]).alias("availability_ok"),
        (F.col("response_time_p95") <= targets["response_time_p95"]).alias("response_time_ok"),
        (F.col("error_rate") <= targets["error_rate"]).alias("error_rate_ok"),
    )

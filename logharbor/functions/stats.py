"""Global statistics: one-row aggregates, exact order statistics, scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logharbor.session import durable

EPSILON = 1e-8


def as_scalar(stats: DataFrame) -> Column:
    """The single row of ``stats`` as a struct column usable in any other plan.

    A scalar subquery is evaluated once and shipped as a value, so no cross join and no
    window without partitions is needed to compare rows with a global statistic.
    """
    return stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias("s")).scalar()


def profile(df: DataFrame, columns: list[str], quartiles: bool = True) -> DataFrame:
    """One row with mean, both sigmas and quartiles of every column.

    ``percentile`` keeps one counter per distinct value, so it is meant for columns of
    bounded cardinality (lengths, hours, codes). ``exact_quantiles`` has no such limit.
    """
    aggregates = []
    for name in columns:
        value = F.col(name).cast("double")
        aggregates += [
            F.avg(value).alias(f"{name}_mean"),
            F.stddev_pop(value).alias(f"{name}_std"),
            F.stddev_samp(value).alias(f"{name}_std_samp"),
        ]
        if quartiles:
            quarts = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
            aggregates.append(quarts.alias(f"{name}_q"))
    return df.agg(*aggregates)


def fitted(stats: DataFrame) -> dict[str, Column]:
    """The single row of ``stats`` as literals, for formulas that use many of its values.

    This is the fit step of a detector: one job, a handful of numbers on the driver.
    """
    row = stats.first()
    literals = {}
    for field in stats.schema.fields:
        value = row[field.name]
        if isinstance(value, list):
            literals[field.name] = F.array(*[F.lit(v) for v in value])
        else:
            literals[field.name] = F.lit(value).cast(field.dataType)
    return literals


def standard_scaled(value: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / population sigma; a constant column is only centred."""
    return (value - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def robust_scaled(value: Column, quartiles: Column) -> Column:
    """(x - median) / (q75 - q25); a zero range divides by one."""
    spread = quartiles[2] - quartiles[0]
    return (value - quartiles[1]) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)


def min_max(df: DataFrame, column: str, output: str) -> DataFrame:
    """(x - min) / (max - min + 1e-8) over the whole frame."""
    bounds = as_scalar(df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    return df.withColumn(output, (F.col(column) - lo) / (hi - lo + F.lit(EPSILON)))


def bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 0 … bins-1, the maximum falling into the last bin."""
    position = F.floor(F.try_divide(value - lo, hi - lo) * F.lit(float(bins)))
    return F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("bigint")


def exact_quantiles(
    df: DataFrame,
    column: str,
    quantiles: list[float],
    small: int = 200_000,
    accuracy: int = 10_000,
    costly: bool = False,
) -> list[float | None]:
    """Exact linearly interpolated quantiles of a column of any cardinality.

    Each round brackets the wanted rank with a mergeable sketch and keeps only the rows
    inside the bracket (about ``4 / accuracy`` of them), so two rounds bring 10^12 rows
    below a million. Only scalars travel to the driver and no task sees more than the
    last bracket, counted by distinct value. A ``costly`` column is computed once and
    kept on shared storage for the passes.
    """
    value = F.col(column).cast("double")
    values = df.select(value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    values = durable(values) if costly else values
    total = values.count()
    if total == 0:
        return [None] * len(quantiles)
    if total <= small:
        row = values.agg(F.percentile("v", F.array(*[F.lit(float(q)) for q in quantiles])).alias("p"))
        return list(row.first()["p"])
    results: list[float | None] = []
    for q in quantiles:
        position = q * (total - 1)
        low_rank = math.floor(position)
        high_rank = min(low_rank + 1, total - 1)
        low, high = _ranked_values(values, total, low_rank, high_rank, small, accuracy)
        results.append(low if low == high else low + (high - low) * (position - low_rank))
    return results


def _ranked_values(
    values: DataFrame, total: int, low_rank: int, high_rank: int, small: int, accuracy: int
) -> tuple[float, float]:
    """The values at two neighbouring 0-based ranks of the sorted column."""
    below, size, current = 0, total, values
    while size > small:
        margin = 2.0 / accuracy
        start = max(0.0, (low_rank - below) / size - margin)
        stop = min(1.0, (high_rank - below + 1) / size + margin)
        bounds = current.agg(
            F.percentile_approx("v", F.array(F.lit(start), F.lit(stop)), F.lit(accuracy)).alias("p"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
        ).first()
        lo = bounds["lo"] if start == 0.0 else bounds["p"][0]
        hi = bounds["hi"] if stop == 1.0 else bounds["p"][1]
        inside = (F.col("v") >= lo) & (F.col("v") <= hi)
        counts = current.agg(
            F.count_if(F.col("v") < lo).alias("less"), F.count_if(inside).alias("kept")
        ).first()
        less, kept = below + counts["less"], counts["kept"]
        if lo == hi and less <= low_rank and high_rank < less + kept:
            return float(lo), float(hi)
        covered = less <= low_rank and high_rank < less + kept
        if not covered or kept == size:
            break
        current, below, size = current.where(inside), less, kept
    # Ties collapse here: one row per distinct value of what is left.
    counted = current.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return _ranks_of_counted(counted, low_rank - below, high_rank - below, size <= small)


def _ranks_of_counted(
    counted: DataFrame, low_rank: int, high_rank: int, few: bool
) -> tuple[float, float]:
    from logharbor.functions.ordering import running_total

    if few:
        upto = F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
        totals = counted.withColumn("upto", upto)
    else:
        totals = running_total(counted, order="v", amount="n", output="upto")
    row = totals.agg(
        F.min(F.when(F.col("upto") > low_rank, F.col("v"))).alias("low"),
        F.min(F.when(F.col("upto") > high_rank, F.col("v"))).alias("high"),
    ).first()
    return float(row["low"]), float(row["high"])


def kth_smallest(df: DataFrame, column: str, k: int, small: int = 200_000) -> float:
    """The k-th smallest value (k from 1) of a column of any cardinality."""
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    total = values.count()
    return _ranked_values(values, total, k - 1, k - 1, small, 10_000)[0]

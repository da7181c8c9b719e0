"""Report data sets: one small table each, every one a single pass of partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logharbor import constants as K
from logharbor.functions import text as X
from logharbor.functions.ordering import hour_start, micros_between
from logharbor.functions.stats import as_scalar, bin_index


def flagged() -> Column:
    return F.col("is_anomaly") == 1


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def rows_counted() -> Column:
    return F.count(F.lit(1))


# --- totals and distributions --------------------------------------------------

def summary(df: DataFrame) -> DataFrame:
    level = F.col("level")
    return df.agg(
        rows_counted().alias("total_logs"),
        F.count_if(flagged()).alias("anomaly_count"),
        percent(F.count_if(flagged()), rows_counted()).alias("anomaly_percentage"),
        F.count_if(level == "ERROR").alias("error_count"),
        F.count_if(level.isin("WARN", "WARNING")).alias("warn_count"),
        F.count_if(level == "INFO").alias("info_count"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def processing_statistics(df: DataFrame, seconds: float | None = None) -> DataFrame:
    stats = df.agg(
        rows_counted().alias("processed"),
        F.count_if(flagged()).alias("anomalies"),
        percent(F.count_if(flagged()), rows_counted()).alias("anomaly_rate"),
    )
    if seconds is None:
        return stats
    return stats.withColumn("entries_per_second", F.col("processed") / F.lit(max(seconds, 1e-3)))


def level_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy("level").agg(rows_counted().alias("n"))
    total = df.agg(rows_counted()).scalar()
    return counts.withColumn("share_percent", percent(F.col("n"), total)).orderBy(F.desc("n"), "level")


def level_anomaly_rate(df: DataFrame) -> DataFrame:
    return df.groupBy("level").agg(
        rows_counted().alias("total"),
        F.count_if(flagged()).alias("anomalies"),
        F.round(percent(F.count_if(flagged()), rows_counted()), 2).alias("anomaly_rate"),
    )


def anomaly_score_stats(df: DataFrame) -> DataFrame:
    """Mean, exact median and range of the scores of flagged rows."""
    from logharbor.functions.stats import exact_quantiles

    hits = df.where(flagged())
    median = exact_quantiles(hits, "anomaly_score", [0.5])[0]
    return hits.agg(
        F.avg("anomaly_score").alias("mean_score"),
        F.lit(median).cast("double").alias("median_score"),
        F.max("anomaly_score").alias("max_score"),
        F.min("anomaly_score").alias("min_score"),
    )


def _histogram(df: DataFrame, value: Column, bins: int, by: list[str]) -> DataFrame:
    rows = df.select(value.cast("double").alias("_v"), *by).where(F.col("_v").isNotNull())
    ends = as_scalar(rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    lo, hi = ends.getField("lo"), ends.getField("hi")
    counts = rows.groupBy(bin_index(F.col("_v"), lo, hi, bins).alias("bin"), *by).agg(
        rows_counted().alias("n")
    )
    width = (hi - lo) / F.lit(float(bins))
    return counts.withColumn("bin_start", lo + F.col("bin") * width)


def length_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    return _histogram(df, X.char_length(F.col("message")), bins, ["is_anomaly"])


def score_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    return _histogram(df, F.col("anomaly_score"), bins, [])


# --- time ----------------------------------------------------------------------

def hourly_timeline(df: DataFrame) -> DataFrame:
    """Hours that occur."""
    return (
        df.where(F.col("timestamp").isNotNull())
        .groupBy(hour_start(F.col("timestamp")).alias("hour"))
        .agg(F.count_if(flagged()).alias("anomalies"), rows_counted().alias("total"))
    )


def hourly_timeline_dense(df: DataFrame) -> DataFrame:
    """Every hour between the first and the last one."""
    sparse = hourly_timeline(df)
    span = sparse.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a IS NOT NULL")
    hours = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    zero = F.lit(0).cast("bigint")
    return hours.join(sparse, "hour", "left").select(
        "hour",
        F.coalesce("anomalies", zero).alias("anomalies"),
        F.coalesce("total", zero).alias("total"),
    )


def anomaly_hours(df: DataFrame) -> DataFrame:
    """Flagged rows per hour of day, all 24 hours."""
    counts = (
        df.where(flagged() & F.col("timestamp").isNotNull())
        .groupBy(F.hour("timestamp").cast("bigint").alias("hour"))
        .agg(rows_counted().alias("n"))
    )
    hours = df.sparkSession.range(24).select(F.col("id").alias("hour"))
    return hours.join(counts, "hour", "left").select(
        "hour", F.coalesce("n", F.lit(0).cast("bigint")).alias("anomalies")
    )


def _clock_counts(df: DataFrame, part: Column, name: str) -> DataFrame:
    return (
        df.where(F.col("timestamp").isNotNull())
        .groupBy(part.cast("bigint").alias(name))
        .agg(rows_counted().alias("n"))
    )


def _peaks(counts: DataFrame, name: str) -> DataFrame:
    """Marks the fullest and the emptiest entry; ties go to the smallest one."""
    ends = as_scalar(
        counts.agg(
            F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias("peak"),
            F.min_by(name, F.struct(F.col("n"), F.col(name))).alias("quiet"),
        )
    )
    return counts.withColumn("is_peak", F.col(name) == ends.getField("peak")).withColumn(
        "is_quiet", F.col(name) == ends.getField("quiet")
    )


def day_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in K.DAY_NAMES]), (number + 1).cast("int"))


def hour_pattern(df: DataFrame) -> DataFrame:
    return _peaks(_clock_counts(df, F.hour("timestamp"), "hour"), "hour")


def weekday_pattern(df: DataFrame) -> DataFrame:
    days = _peaks(_clock_counts(df, F.weekday("timestamp"), "day_of_week"), "day_of_week")
    return days.withColumn("day_name", day_name(F.col("day_of_week")))


def anomaly_patterns(df: DataFrame) -> DataFrame:
    """Hour and weekday distribution of the flagged rows, in one table."""
    hits = df.where(flagged())
    zero = F.lit(None).cast("string")
    hours = hour_pattern(hits).select(
        F.lit("hour").alias("kind"), F.col("hour").alias("position"), zero.alias("day_name"), "n", "is_peak"
    )
    days = weekday_pattern(hits).select(
        F.lit("weekday").alias("kind"), F.col("day_of_week").alias("position"), "day_name", "n", "is_peak"
    )
    return hours.unionByName(days)


def daily_trend(df: DataFrame) -> DataFrame:
    """Least-squares slope of daily counts over the days that occur; none for one day."""
    daily = (
        df.where(F.col("timestamp").isNotNull())
        .groupBy(F.to_date("timestamp").alias("day"))
        .agg(rows_counted().alias("n"))
    )
    # One row per calendar day: the window is as long as the log is old, not as it is big.
    numbered = daily.withColumn("x", (F.row_number().over(W.orderBy("day")) - 1).cast("double"))
    slope = F.regr_slope(F.col("n").cast("double"), F.col("x"))
    trend = numbered.agg(F.round(slope, 6).alias("slope"), rows_counted().alias("days")).where("days > 1")
    return trend.withColumn(
        "direction",
        F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable"),
    )


def seasonality(df: DataFrame, least_rows: int = 48) -> DataFrame:
    """Spread of the hour-of-day and weekday counts relative to their mean."""
    rows = df.agg(rows_counted()).scalar()
    parts = []
    for kind, part in (("hourly", F.hour("timestamp")), ("weekly", F.weekday("timestamp"))):
        counts = _clock_counts(df, part, "position")
        stats = counts.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"))
        parts.append(
            stats.select(
                F.lit(kind).alias("kind"),
                F.coalesce(F.try_divide("std", "mean"), F.lit(0.0)).alias("strength"),
                F.coalesce(F.col("std") > F.col("mean") * 0.1, F.lit(False)).alias("detected"),
            )
        )
    return parts[0].unionByName(parts[1]).where(rows >= least_rows)


def time_range(df: DataFrame) -> DataFrame:
    ends = df.agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    micros = micros_between(F.col("start_time"), F.col("end_time"))
    return ends.withColumn("duration_hours", micros / F.lit(3.6e9))


def time_findings(df: DataFrame) -> DataFrame:
    """Time range, key findings and recommendations as one row."""
    peak_hour = hour_pattern(df).where("is_peak").select("hour").scalar()
    peak_day = weekday_pattern(df).where("is_peak").select("day_name").scalar()
    direction = daily_trend(df).select("direction").scalar()
    season = seasonality(df)
    hourly = season.where("kind = 'hourly'").select("detected").scalar()
    weekly = season.where("kind = 'weekly'").select("detected").scalar()
    strength = season.where("kind = 'hourly'").select("strength").scalar()
    alarm_hour = (
        anomaly_patterns(df).where("kind = 'hour' AND is_peak").select("position").scalar()
    )

    def filled(sentence: str, value: Column) -> Column:
        head, tail = sentence.split("{}")
        return F.concat(F.lit(head), value, F.lit(tail))

    findings = F.array_compact(
        F.array(
            filled(K.TIME_PEAK_HOUR, peak_hour.cast("string")),
            filled(K.TIME_PEAK_DAY, peak_day),
            filled(K.TIME_TREND, direction),
            F.when(hourly, F.lit(K.TIME_HOURLY)),
            F.when(weekly, F.lit(K.TIME_WEEKLY)),
        )
    )
    advice = F.array_compact(
        F.array(
            filled(K.TIME_ADVICE_HOUR, alarm_hour.cast("string")),
            F.when(strength > 0.5, F.lit(K.TIME_ADVICE_SEASONAL)),
            F.when(direction == "increasing", F.lit(K.TIME_ADVICE_GROWTH)),
            F.lit(K.TIME_ADVICE_ALWAYS),
        )
    )
    return time_range(df).select(
        "*", findings.alias("key_findings"), advice.alias("recommendations")
    )


# --- risk and compliance ---------------------------------------------------------

def risk_of(rate_percent: Column, inclusive: bool) -> Column:
    high = rate_percent >= 10 if inclusive else rate_percent > 10
    medium = rate_percent >= 5 if inclusive else rate_percent > 5
    return F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def _advice(risk: Column, texts: dict[str, tuple[str, ...]]) -> Column:
    arrays = {k: F.array(*[F.lit(t) for t in v]) for k, v in texts.items()}
    return F.when(risk == "HIGH", arrays["HIGH"]).when(risk == "MEDIUM", arrays["MEDIUM"]).otherwise(arrays["LOW"])


def risk_level(df: DataFrame) -> DataFrame:
    """Risk by anomaly rate under both rules, with the advice that goes with each."""
    stats = df.agg(
        percent(F.count_if(flagged()), rows_counted()).alias("anomaly_rate"),
        percent(F.count_if(F.col("level") == "ERROR"), rows_counted()).alias("error_rate"),
    )
    rows = stats.withColumn("summary_risk", risk_of(F.col("anomaly_rate"), False)).withColumn(
        "executive_risk", risk_of(F.col("anomaly_rate"), True)
    )
    errors = F.when(F.col("error_rate") > 5, F.array(F.lit(K.ERROR_RATE_ADVICE))).otherwise(
        F.array().cast("array<string>")
    )
    executive = F.concat(
        _advice(F.col("executive_risk"), K.EXECUTIVE_ADVICE), F.array(F.lit(K.EXECUTIVE_ADVICE_ALWAYS))
    )
    return rows.select(
        "*",
        F.concat(_advice(F.col("summary_risk"), K.SUMMARY_ADVICE), errors).alias("summary_advice"),
        executive.alias("executive_advice"),
        F.when(F.col("executive_risk") == "HIGH", K.RISK_DESCRIPTIONS["HIGH"])
        .when(F.col("executive_risk") == "MEDIUM", K.RISK_DESCRIPTIONS["MEDIUM"])
        .otherwise(K.RISK_DESCRIPTIONS["LOW"]).alias("risk_description"),
    )


def executive_impact(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(flagged() & (F.col("level") == "ERROR")).alias("error_anomalies"),
        F.count_if(flagged() & (F.col("level") == "WARNING")).alias("warning_anomalies"),
    )


def compliance_counts(df: DataFrame) -> DataFrame:
    lowered = F.lower(F.coalesce(F.col("message"), F.lit("")))
    return df.agg(
        rows_counted().alias("total_entries"),
        F.count_if(flagged()).alias("anomalies"),
        percent(F.count_if(flagged()), rows_counted()).alias("anomaly_rate"),
        F.count_if(X.contains_any(lowered, K.AUTH_KEYWORDS)).alias("auth_events"),
        F.count_if(F.col("level") == "ERROR").alias("error_events"),
        F.count_if(flagged() & X.contains_any(lowered, K.SECURITY_KEYWORDS)).alias("security_anomalies"),
    )


def compliance_findings(df: DataFrame) -> DataFrame:
    counts = compliance_counts(df)
    total, errors, rate = F.col("total_entries"), F.col("error_events"), F.col("anomaly_rate")

    def finding(severity: str, category: str, description: Column, advice: str) -> Column:
        return F.struct(
            F.lit(severity).alias("severity"),
            F.lit(category).alias("category"),
            description.alias("description"),
            F.lit(advice).alias("recommendation"),
        )

    high = finding(
        "HIGH", "Monitoring",
        F.format_string(K.FINDING_RATE, rate), K.FINDING_MONITORING,
    )
    medium = finding(
        "MEDIUM", "Error Handling",
        F.format_string(K.FINDING_ERROR_RATE, errors, total),
        K.FINDING_ERRORS,
    )
    found = F.array_compact(
        F.array(F.when(rate > 10, high), F.when(errors > total * 0.05, medium))
    )
    return counts.select(F.inline(found))


# --- top rows ----------------------------------------------------------------------

def top_anomalies(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest scores among the flagged rows; line order breaks ties."""
    return (
        df.where(flagged())
        .orderBy(F.desc("anomaly_score"), "source", "line_number")
        .limit(n)
    )


def first_rows(df: DataFrame, n: int, anomalies_only: bool = False) -> DataFrame:
    rows = df.where(flagged()) if anomalies_only else df
    return rows.orderBy("line_number", "source").limit(n)


# --- comparisons of measurements -----------------------------------------------------

def benchmark_diff(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Change of time and memory per benchmark; only benchmarks in both frames."""
    both = baseline.select(*keys, F.col("time").alias("baseline_time"), F.col("memory").alias("baseline_memory")).join(
        current.select(*keys, F.col("time").alias("current_time"), F.col("memory").alias("current_memory")), keys
    )
    change = lambda new, old: F.try_divide((F.col(new) - F.col(old)) * 100.0, F.col(old))
    rows = both.withColumn("time_change", change("current_time", "baseline_time")).withColumn(
        "memory_change", change("current_memory", "baseline_memory")
    )
    return rows.withColumn(
        "verdict",
        F.when((F.col("time_change") > 10) | (F.col("memory_change") > 20), "regression")
        .when((F.col("time_change") < -5) | (F.col("memory_change") < -10), "improvement")
        .otherwise("unchanged"),
    )


def scaling_fit(runs: DataFrame, by: list[str]) -> DataFrame:
    """Slope of time over size, growth class and throughput rating per group of runs."""
    # A group holds one row per measured size.
    w = W.partitionBy(*by).orderBy("size", "time")
    rows = runs.withColumn("size_ratio", F.col("size") / F.lag("size").over(w)).withColumn(
        "time_ratio", F.col("time") / F.lag("time").over(w)
    )
    stats = rows.groupBy(*by).agg(
        F.regr_slope(F.col("time").cast("double"), F.col("size").cast("double")).alias("slope"),
        F.avg("size_ratio").alias("s"),
        F.avg("time_ratio").alias("t"),
        F.avg(F.col("size") / F.col("time")).alias("throughput"),
    )
    s, t = F.col("s"), F.col("t")
    rating = None
    for least, name in K.THROUGHPUT_RATINGS:
        hit = F.col("throughput") > least
        rating = F.when(hit, name) if rating is None else rating.when(hit, name)
    growth = (
        F.when(t.isNull(), "insufficient_data")
        .when(t <= s * 1.2, K.GROWTH_CLASSES["linear"])
        .when(t <= F.pow(s, F.lit(1.5)) * 1.2, K.GROWTH_CLASSES["linearithmic"])
        .when(t <= s * s * 1.2, K.GROWTH_CLASSES["quadratic"])
        .otherwise(K.GROWTH_CLASSES["more"])
    )
    return stats.select(*by, "slope", growth.alias("growth"), "throughput", rating.otherwise("poor").alias("rating"))

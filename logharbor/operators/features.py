"""Numeric features of log rows, all as built-in column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from logharbor import constants as K
from logharbor.functions import text as X
from logharbor.functions.ordering import centred_counts, micros_between, running_total, salted_lookup, with_previous
from logharbor.session import durable

ROW_KEY = ("source", "line_number")


def hour_of(ts: str = "timestamp", missing: int | None = 0):
    value = F.hour(ts).cast("bigint")
    return value if missing is None else F.coalesce(value, F.lit(missing).cast("bigint"))


def weekday_of(ts: str = "timestamp", missing: int | None = 0):
    """Monday is 0."""
    value = F.weekday(ts).cast("bigint")
    return value if missing is None else F.coalesce(value, F.lit(missing).cast("bigint"))


def with_basic_features(df: DataFrame, scheme: str = "core") -> DataFrame:
    """Length, words, severity, hour and weekday."""
    return df.select(
        "*",
        X.char_length(F.col("message")).alias("message_length"),
        F.coalesce(X.word_count(F.col("message")), F.lit(0).cast("bigint")).alias("word_count"),
        X.severity(F.col("level"), scheme).alias("severity_score"),
        hour_of().alias("hour"),
        weekday_of().alias("day_of_week"),
    )


def with_cyclical_features(df: DataFrame) -> DataFrame:
    hour = 2 * math.pi * hour_of() / 24
    day = 2 * math.pi * weekday_of() / 7
    return df.select(
        "*",
        F.sin(hour).alias("hour_sin"),
        F.cos(hour).alias("hour_cos"),
        F.sin(day).alias("day_sin"),
        F.cos(day).alias("day_cos"),
    )


def with_flags(df: DataFrame) -> DataFrame:
    message = F.col("message")
    return df.select(
        "*",
        X.complexity(message).alias("message_complexity"),
        *[X.flag(message, name).alias(name) for name in K.FLAG_PATTERNS],
    )


def with_linguistic_features(df: DataFrame) -> DataFrame:
    """Counts on the message template; placeholders are the only upper-case words."""
    rows = df.withColumn("_t", X.template(F.col("message"))).withColumn("_w", X.words(F.col("_t")))
    count = F.size("_w")
    at_least_one = F.greatest(count, F.lit(1))
    upper = F.size(F.filter("_w", lambda w: (w == F.upper(w)) & (w != F.lower(w))))
    return rows.select(
        *df.columns,
        count.cast("bigint").alias("words"),
        F.length("_t").cast("bigint").alias("chars"),
        (F.size(F.array_distinct("_w")) / at_least_one).alias("lexical_diversity"),
        (upper / at_least_one).alias("uppercase_ratio"),
        *[
            X.occurrences(F.col("_t"), f"<{p}>").alias(f"{p.lower()}_count")
            for p in ("NUMBER", "IP", "DATE", "TIME")
        ],
    )


def with_error_keywords(df: DataFrame) -> DataFrame:
    lowered = F.lower(F.coalesce(F.col("message"), F.lit("")))
    return df.select(
        "*", *[lowered.contains(k).cast("int").alias(f"has_{k}") for k in K.ERROR_KEYWORDS]
    )


def with_multimodal_features(df: DataFrame) -> DataFrame:
    message = F.coalesce(F.col("message"), F.lit(""))
    return df.select(
        "*",
        *[
            getattr(F, part)("timestamp").cast("bigint").alias(name)
            for part, name in (
                ("hour", "hour"), ("minute", "minute"), ("dayofmonth", "day"),
                ("weekday", "weekday"), ("month", "month"),
            )
        ],
        X.char_length(message).alias("message_length"),
        X.occurrences(message, " ").alias("space_count"),
        X.occurrences(message, "ERROR").alias("error_count"),
        X.occurrences(message, "WARNING").alias("warning_count"),
        X.occurrences(message, "INFO").alias("info_count"),
    )


def with_stream_features(df: DataFrame) -> DataFrame:
    message = F.coalesce(F.col("message"), F.lit(""))
    return df.select(
        "*",
        X.char_length(message).alias("message_length"),
        X.occurrences(message, "ERROR").alias("error_count"),
        X.occurrences(message, "WARNING").alias("warning_count"),
        X.occurrences(message, "INFO").alias("info_count"),
        X.word_count(message).alias("word_count"),
    )


def with_text_shape(df: DataFrame) -> DataFrame:
    """Features of the voting ensemble and the autoencoder, with their fill values."""
    message = F.col("message")
    return df.select(
        "*",
        F.coalesce(F.length(message), F.lit(0)).cast("bigint").alias("message_length"),
        F.coalesce(X.word_count(message), F.lit(5).cast("bigint")).alias("word_count"),
        X.severity(F.col("level"), "five_level").alias("severity_score"),
        hour_of(missing=12).alias("hour"),
        weekday_of(missing=3).alias("day_of_week"),
        F.coalesce(X.distinct_chars(message), F.lit(10).cast("bigint")).alias("char_diversity"),
        X.special_char_ratio(message).alias("special_char_ratio"),
    )


def with_csv_enrichment(df: DataFrame) -> DataFrame:
    score = F.col("anomaly_score")
    return df.select(
        "*",
        F.length("message").cast("bigint").alias("message_length"),
        X.word_count(F.col("message")).alias("word_count"),
        hour_of(missing=None).alias("hour"),
        weekday_of(missing=None).alias("day_of_week"),
        F.weekday("timestamp").isin(5, 6).alias("is_weekend"),
        X.severity(F.col("level"), "csv").alias("severity_score"),
        F.when(score <= 0.3, "Low").when(score <= 0.7, "Medium")
        .when(score.isNotNull(), "High").alias("confidence_level"),
    )


def level_table(df: DataFrame) -> DataFrame:
    """Every upper-cased level once: ``level_name``, its ``level_index`` (0, 1, ... in order of the names) and its rows ``n``."""
    counts = df.select(F.upper("level").alias("level_name")).where("level_name IS NOT NULL").groupBy("level_name").agg(F.count(F.lit(1)).alias("n"))
    numbered = running_total(durable(counts.withColumn("_one", F.lit(1))), order="level_name", amount="_one", output="_upto")
    return durable(numbered.select("level_name", (F.col("_upto") - 1).cast("bigint").alias("level_index"), "n"))


def with_level_index(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Adds ``level_index`` from a table of levels, by default that of ``df``; null for a null level or one that is not in
    the table. However many levels there are, each has an index of its own."""
    table = level_table(df) if table is None else table
    rows = df.withColumn("level_name", F.upper("level"))
    return salted_lookup(rows, table.select("level_name", "level_index", "n"), ["level_name"], "n", ROW_KEY).drop("level_name")


def level_one_hot(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column for each of the named upper-cased levels; ``with_level_index`` tells all levels apart."""
    upper = F.upper("level")
    return df.select(
        "*", *[F.coalesce((upper == lv).cast("int"), F.lit(0)).alias(f"level_{lv}") for lv in levels]
    )


def with_time_diff(df: DataFrame, block: int | None = None) -> DataFrame:
    """Seconds since the previous line of the same source; 0 where either time is missing."""
    options = {} if block is None else {"block": block}
    rows = with_previous(df, "timestamp", "_prev", **options)
    micros = micros_between(F.col("_prev"), F.col("timestamp"))
    seconds = F.coalesce(micros / F.lit(1e6), F.lit(0.0))
    return rows.withColumn("time_diff_seconds", seconds).drop("_prev")


def with_log_frequency(df: DataFrame, half_seconds: int = 150) -> DataFrame:
    """Number of rows within ± ``half_seconds``, the row itself included; 0 without a time."""
    # Read three times by the lookup.
    counts = durable(centred_counts(df, "timestamp", half_seconds, "log_frequency_5min"))
    rows = salted_lookup(df, counts, ["timestamp"], "n", ROW_KEY)
    filled = F.coalesce(F.col("log_frequency_5min"), F.lit(0)).cast("bigint")
    return rows.withColumn("log_frequency_5min", filled)


def column_profile(df: DataFrame) -> DataFrame:
    """Range and distinct ratio per column with the narrowest type that fits.

    Distinct strings are counted exactly, one two-phase aggregate over all columns.
    """
    numeric = [n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    strings = [n for n, t in df.dtypes if t == "string"]
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for name in numeric:
        aggregates += [F.min(name).cast("double").alias(f"{name}_min"), F.max(name).cast("double").alias(f"{name}_max")]
    aggregates += [F.count_distinct(name).alias(f"{name}_distinct") for name in strings]
    stats = df.agg(*aggregates)
    types = dict(df.dtypes)
    none = F.lit(None).cast("double")
    rows = []
    for name in numeric:
        lo, hi = F.col(f"{name}_min"), F.col(f"{name}_max")
        if types[name] in ("float", "double"):
            suggestion = F.when((lo >= -3.4028234663852886e38) & (hi <= 3.4028234663852886e38), "float").otherwise("double")
        else:
            suggestion = (
                F.when((lo >= -128) & (hi <= 127), "tinyint")
                .when((lo >= -32768) & (hi <= 32767), "smallint")
                .when((lo >= -2147483648) & (hi <= 2147483647), "int")
                .otherwise("bigint")
            )
        rows.append((name, types[name], lo, hi, none, suggestion))
    for name in strings:
        ratio = F.col(f"{name}_distinct") / F.greatest(F.col("_n"), F.lit(1))
        rows.append((name, "string", none, none, ratio, F.when(ratio < 0.5, "categorical").otherwise("string")))
    labels = ("column_name", "current_type", "min_value", "max_value", "distinct_ratio", "suggested_type")
    structs = [
        F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in zip(labels, row)])
        for row in rows
    ]
    return stats.select(F.inline(F.array(*structs)))

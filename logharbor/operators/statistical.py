"""Detectors that compare numeric features with global statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logharbor.functions import text as X
from logharbor.functions.stats import fitted, profile

FEATURES = ("message_length", "level_value", "hour", "minute", "word_count")


def statistical_features(df: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return df.select(
        "*",
        X.char_length(F.col("message")).alias("message_length"),
        X.severity(F.col("level"), "four_level").alias("level_value"),
        F.coalesce(F.hour("timestamp").cast("bigint"), zero).alias("hour"),
        F.coalesce(F.minute("timestamp").cast("bigint"), zero).alias("minute"),
        F.coalesce(X.word_count(F.col("message")), zero).alias("word_count"),
    )


def detect_statistical(
    df: DataFrame,
    z_threshold: float = 3.0,
    iqr_factor: float = 1.5,
    cut: float = 0.5,
    features: tuple[str, ...] = FEATURES,
) -> DataFrame:
    """Largest z-score and largest distance beyond the quartile fences, each clipped to 1.

    A feature without spread adds nothing. Means, sigmas and quartiles come from one
    aggregate; the features are lengths, codes and clock parts, so the exact quartiles
    need few counters.
    """
    rows = statistical_features(df) if features == FEATURES else df
    stats = fitted(profile(rows, list(features)))
    z_parts, iqr_parts = [F.lit(0.0)], [F.lit(0.0)]
    for name in features:
        value = F.col(name).cast("double")
        distance = F.abs(value - stats[f"{name}_mean"])
        z_parts.append(F.coalesce(F.try_divide(distance, stats[f"{name}_std"]), F.lit(0.0)))
        q1, q3 = stats[f"{name}_q"][0], stats[f"{name}_q"][2]
        spread = q3 - q1
        below = (q1 - F.lit(iqr_factor) * spread - value) / F.nullif(spread, F.lit(0.0))
        above = (value - q3 - F.lit(iqr_factor) * spread) / F.nullif(spread, F.lit(0.0))
        iqr_parts += [F.coalesce(below, F.lit(0.0)), F.coalesce(above, F.lit(0.0))]
    z_score = F.least(F.greatest(*z_parts) / F.lit(z_threshold), F.lit(1.0))
    iqr_score = F.least(F.greatest(*iqr_parts), F.lit(1.0))
    return (
        rows.withColumn("z_score", z_score)
        .withColumn("iqr_score", iqr_score)
        .withColumn("anomaly_score", F.greatest("z_score", "iqr_score"))
        .withColumn("is_anomaly", (F.col("anomaly_score") > F.lit(cut)).cast("int"))
    )


def detect_long_messages(df: DataFrame, threshold: float = 2.0) -> DataFrame:
    """|z| of the message length with the sample sigma."""
    rows = df.withColumn("message_length", X.char_length(F.col("message")))
    stats = fitted(profile(rows, ["message_length"], quartiles=False))
    distance = F.abs(F.col("message_length") - stats["message_length_mean"])
    score = F.try_divide(distance, stats["message_length_std_samp"])
    return rows.withColumn("anomaly_score", score).withColumn(
        "is_anomaly", F.coalesce(score > F.lit(threshold), F.lit(False)).cast("int")
    )

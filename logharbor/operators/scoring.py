"""Turn scores into flags, confidences and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logharbor.config import check_contamination
from logharbor.functions.stats import EPSILON, as_scalar, exact_quantiles, fitted

AUTO_OFFSET = -0.5


def score_cut(
    df: DataFrame, score: str, contamination: float | str, costly: bool = False
) -> float | None:
    """The score below which the given share of rows lies; ``'auto'`` is a fixed cut."""
    share = check_contamination(contamination)
    if share == "auto":
        return AUTO_OFFSET
    return exact_quantiles(df, score, [share], costly=costly)[0]


def flag_below(df: DataFrame, score: str, cut: float | None) -> DataFrame:
    """Lower scores are more anomalous; rows under the cut are flagged."""
    flagged = F.lit(False) if cut is None else F.col(score) < F.lit(cut)
    return df.withColumn("is_anomaly", F.coalesce(flagged, F.lit(False)).cast("int"))


def cut_by_contamination(
    df: DataFrame, score: str, contamination: float | str, costly: bool = False
) -> DataFrame:
    return flag_below(df, score, score_cut(df, score, contamination, costly))


def with_confidence(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """1 - min-max(score): the lowest score is the most certain anomaly."""
    bounds = as_scalar(df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")))
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    return df.withColumn("confidence", 1 - (F.col(score) - lo) / (hi - lo + F.lit(EPSILON)))


def majority_vote(df: DataFrame, votes: list[str], scores: list[str]) -> DataFrame:
    """Flag by the rounded mean of 0/1 votes (half goes to even), score by the mean score.

    A member without a vote for a row counts as 0.
    """
    n = F.lit(float(len(votes)))
    mean_vote = _total([F.coalesce(F.col(v), F.lit(0)) for v in votes]) / n
    mean_score = _total([F.coalesce(F.col(s), F.lit(0.0)) for s in scores]) / F.lit(float(len(scores)))
    return df.withColumn("is_anomaly", F.bround(mean_vote).cast("int")).withColumn(
        "anomaly_score", mean_score
    )


def weighted_vote(
    df: DataFrame,
    members: dict[str, str],
    weights: dict[str, float] | None = None,
    strategy: str = "soft",
    quantile: float = 0.95,
) -> DataFrame:
    """Combine member scores (lower = more anomalous) into one score and cut it.

    Soft: weighted mean of the negated, min-max scaled scores. Hard: share of members
    whose negated score exceeds 0.5. The combination is min-max scaled again and rows
    over its ``quantile`` are flagged.
    """
    weights = weights or {}
    aggregates = []
    for name, column in members.items():
        negated = -F.col(column).cast("double")
        aggregates += [F.min(negated).alias(f"{name}_lo"), F.max(negated).alias(f"{name}_hi")]
    bounds = fitted(df.agg(*aggregates))
    scaled = {}
    for name, column in members.items():
        lo, hi = bounds[f"{name}_lo"], bounds[f"{name}_hi"]
        scaled[name] = (-F.col(column).cast("double") - lo) / (hi - lo + F.lit(EPSILON))
    if strategy == "hard":
        terms = [(-F.col(c) > 0.5).cast("double") for c in members.values()]
    else:
        terms = [F.lit(float(weights.get(n, 1.0))) * s for n, s in scaled.items()]
    combined = _total(terms) / F.lit(float(len(members)))
    rows = df.select("*", *[s.alias(f"{n}_score") for n, s in scaled.items()], combined.alias("_combined"))
    ends = as_scalar(rows.agg(F.min("_combined").alias("lo"), F.max("_combined").alias("hi")))
    lo, hi = ends.getField("lo"), ends.getField("hi")
    rows = rows.withColumn(
        "anomaly_score", (F.col("_combined") - lo) / (hi - lo + F.lit(EPSILON))
    ).drop("_combined")
    threshold = exact_quantiles(rows, "anomaly_score", [quantile])[0]
    return rows.withColumn("ensemble_threshold", F.lit(threshold).cast("double")).withColumn(
        "is_anomaly", (F.col("anomaly_score") > F.col("ensemble_threshold")).cast("int")
    )


def _total(columns: list[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total


def without_detection(df: DataFrame, with_confidence: bool = False) -> DataFrame:
    """Same rows, nothing flagged: detection switched off or no usable feature."""
    rows = df.withColumn("is_anomaly", F.lit(0)).withColumn("anomaly_score", F.lit(0.0))
    return rows.withColumn("confidence", F.lit(1.0)) if with_confidence else rows


def importance_table(spark: SparkSession, models: dict[str, object]) -> DataFrame:
    """``model, feature, importance, place`` of fitted models, the most important feature of each first, ties by name."""
    rows = []
    for name, model in models.items():
        ordered = sorted(model.feature_importance().items(), key=lambda p: (-p[1], p[0]))
        rows += [(name, feature, float(value), place) for place, (feature, value) in enumerate(ordered, 1)]
    return spark.createDataFrame(rows, "model string, feature string, importance double, place int")


def explain_rows(df: DataFrame) -> DataFrame:
    """A label per row and the size of its decision value."""
    return df.select(
        "*",
        F.when(F.col("is_anomaly") == 1, "Anomaly").otherwise("Normal").alias("prediction"),
        F.abs("anomaly_score").alias("decision_confidence"),
    )

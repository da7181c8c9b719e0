"""Messages whose words are rare or whose direction is far from the mean message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logharbor.functions import text as X
from logharbor.functions.ordering import salted_lookup
from logharbor.functions.stats import min_max
from logharbor.operators import tfidf as T
from logharbor.session import durable

_FREQUENT = 10_000


def rarity_scores(df: DataFrame, key: Sequence[str], template: Column | None = None, weight: str | None = None) -> DataFrame:
    """Mean of 1 - share over the template words of a row; 0.5 without words.

    ``weight`` names a column with the number of equal rows a row stands for. Words with more
    than one in ten thousand of all occurrences number at most ten thousand, so their shares are
    broadcast and no frequent word is ever shuffled. Only the rare words meet their shares in
    a shuffled join.
    """
    words = X.words(X.template(F.col("message")) if template is None else template)
    times = F.lit(1) if weight is None else F.col(weight)
    exploded = df.select(*key, times.alias("_times"), F.explode_outer(words).alias("word"))
    counts = exploded.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("_times").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    shares = counts.select("word", (F.col("n") / total).alias("share"))
    frequent = F.broadcast(shares.where(F.col("share") > 1.0 / _FREQUENT))
    rare = shares.where(F.col("share") <= 1.0 / _FREQUENT)
    common_part = (
        exploded.join(frequent, "word", "left")
        .groupBy(*key)
        .agg(F.sum(1 - F.col("share")).alias("_common"), F.count("word").alias("_words"))
    )
    rare_part = (
        exploded.join(frequent, "word", "left_anti")
        .join(rare, "word")
        .groupBy(*key)
        .agg(F.sum(1 - F.col("share")).alias("_rare"))
    )
    zero = F.lit(0.0)
    total_rarity = F.coalesce("_common", zero) + F.coalesce("_rare", zero)
    return common_part.join(rare_part, list(key), "left").select(
        *key,
        F.when(F.col("_words") == 0, F.lit(0.5)).otherwise(total_rarity / F.col("_words")).alias("rarity"),
    )


def distance_from_mean(templates: DataFrame, max_features: int = 1000) -> DataFrame:
    """1 - cosine between a template's TF-IDF vector and the mean vector of all rows, for templates
    with terms; ``templates`` holds ``template`` and ``n``, the rows it stands for."""
    terms = T.term_counts(templates, ["template", "n"], F.col("template"))
    n = templates.agg(F.sum("n")).scalar()
    counted = terms.groupBy("term").agg(F.sum(F.col("tf") * F.col("n")).alias("total"), F.sum("n").alias("df"))
    top = counted.orderBy(F.desc("total"), "term").limit(max_features)
    vocabulary = top.withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0)
    weights = T.weights(terms, vocabulary, ["template", "n"])
    centre = weights.groupBy("term").agg((F.sum(F.col("weight") * F.col("n")) / n).alias("centre"))
    norm = centre.agg(F.sqrt(F.sum(F.col("centre") * F.col("centre")))).scalar()
    # The centre has at most ``max_features`` rows.
    return (
        weights.join(F.broadcast(centre), "term")
        .groupBy("template")
        .agg(F.sum(F.col("weight") * F.col("centre")).alias("_dot"))
        .select("template", (1 - F.col("_dot") / norm).alias("distance"))
    )


def detect_nlp(
    df: DataFrame,
    key: Sequence[str] = ("source", "line_number"),
    cut: float = 0.7,
    rarity_weight: float = 0.6,
    max_features: int = 1000,
) -> DataFrame:
    """All scores depend on the template of a message alone, so each template is scored once, with
    the number of its rows as weight, and the rows look their template up."""
    template = F.coalesce(X.template(F.col("message")), F.lit("")).alias("template")
    templates = durable(df.select(template).groupBy("template").agg(F.count(F.lit(1)).alias("n")))
    rarity = rarity_scores(templates, ["template"], F.col("template"), "n")
    distance = distance_from_mean(templates, max_features)
    raw = durable(
        templates.join(rarity, "template").join(distance, "template", "left").select(
            "template", "n", "rarity", F.coalesce("distance", F.lit(1.0)).alias("distance")
        )
    )
    scaled = min_max(min_max(raw, "rarity", "linguistic_score"), "distance", "semantic_score")
    score = F.col("linguistic_score") * rarity_weight + F.col("semantic_score") * (1 - rarity_weight)
    scores = scaled.select("template", "n", "linguistic_score", "semantic_score", score.alias("anomaly_score"))
    rows = salted_lookup(df.withColumn("template", template), durable(scores), ["template"], "n", list(key))
    return rows.drop("template").withColumn("is_anomaly", (F.col("anomaly_score") > F.lit(cut)).cast("int"))

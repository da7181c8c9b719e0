"""Word statistics and TF-IDF as relations of (row, term, weight)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logharbor.functions import text as X
from logharbor.session import partitions_for
from logharbor.stopwords import ENGLISH

#: Texts whose terms one task counts; a text has some dozen terms.
_ROWS_PER_TASK = 100_000


def placed_by_key(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """``n`` rows placed by their key, a bounded number in a task.

    The number of partitions is given, since terms take many times the space of the rows that
    adaptive execution would join into one task.
    """
    return df.repartition(partitions_for(n, df.sparkSession, _ROWS_PER_TASK), *key)


def tokens(text: Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Lower-cased words of two or more characters that are not stop words."""
    low = F.lower(text)
    # In a text of ASCII alone both patterns find the same, the first in a third of the time.
    plain = F.regexp_extract_all(low, F.lit(r"\w\w+"), F.lit(0))
    found = F.when(F.octet_length(low) == F.length(low), plain).otherwise(
        F.regexp_extract_all(low, F.lit(X.UNICODE + r"\b\w\w+\b"), F.lit(0))
    )
    return F.filter(found, lambda w: ~w.isin(list(stop_words))) if stop_words else found


def with_bigrams(words: Column) -> Column:
    """The words followed by all pairs of neighbours."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)


def term_counts(
    df: DataFrame,
    key: Sequence[str],
    text: Column,
    bigrams: bool = True,
    stop_words: Sequence[str] = ENGLISH,
) -> DataFrame:
    """Rows (key, term, tf).

    The term arrays are placed by row key once; counting per row and term and the later
    norms per row all happen in that placement.
    """
    words = tokens(F.coalesce(text, F.lit("")), stop_words)
    terms = df.select(*key, (X.let(words, with_bigrams) if bigrams else words).alias("t"))
    # The outer form keeps the optimizer from testing the arrays a second time.
    return (
        placed_by_key(terms, key, df.count())
        .select(*key, F.explode_outer("t").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy(*key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(
    terms: DataFrame,
    documents: DataFrame,
    max_features: int,
    min_df: int = 1,
    max_df: float = 1.0,
) -> DataFrame:
    """Terms with total, document frequency and smooth idf; the most frequent ones only.

    At most ``max_features`` rows, so the result may be broadcast.
    """
    n = documents.agg(F.count(F.lit(1))).scalar()
    counted = terms.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    kept = counted.where((F.col("df") >= min_df) & (F.col("df") <= n * F.lit(float(max_df))))
    top = kept.orderBy(F.desc("total"), "term").limit(max_features)
    return top.withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0)


def weights(terms: DataFrame, vocabulary: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows (key, term, tf, weight) with unit Euclidean length per row key.

    A row has few terms, so its norm is taken over the row's own partition of a window.
    """
    from pyspark.sql import Window as W

    known = terms.join(F.broadcast(vocabulary.select("term", "idf")), "term")
    raw = known.withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(*key)))
    return raw.select(*key, "term", "tf", (F.col("raw") / norm).alias("weight"))


def template_words(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows (key, word, tf) of the message templates."""
    words = df.select(*key, F.explode(X.words(X.template(F.col("message")))).alias("word"))
    return words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("tf"))


def word_frequencies(df: DataFrame) -> DataFrame:
    """Distinct words of all templates with their share of all words."""
    words = df.select(F.explode(X.words(X.template(F.col("message")))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("frequency", F.col("n") / total)

"""Rare sequences of event types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from logharbor import constants as K
from logharbor.functions.ordering import with_halo
from logharbor.functions.text import event_type

KINDS = len(K.EVENT_TYPE_KEYWORDS) + 1
_SMALL = 100_000
ORDER = ("timestamp", "source", "line_number")


def sequence_scores(df: DataFrame, length: int = 3, partitions: int | None = None) -> DataFrame:
    """Per row: mean rarity (1 - share) of the n-grams of event types that cover it.

    Rows are cut into ordered pieces with ``length - 1`` border rows from each neighbour,
    so leads, lags and the covering average stay inside a piece. An n-gram that would
    reach beyond the last row does not exist and is skipped by the average.
    """
    slim = df.select(*ORDER, event_type(F.col("message")).alias("event_type"))
    reach = length - 1
    pieces = with_halo(slim, ORDER, before=reach, after=reach, partitions=partitions)
    order = W.partitionBy("piece").orderBy(*ORDER)
    types = [F.lead("event_type", k).over(order) if k else F.col("event_type") for k in range(length)]
    grams = pieces.withColumn(
        "gram", F.when(types[-1].isNotNull(), F.concat_ws(">", *types))
    )
    counts = grams.where(F.col("home") & F.col("gram").isNotNull()).groupBy("gram").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n")).scalar()
    shares = counts.select("gram", (F.col("n") / total).alias("share"))
    if KINDS**length <= _SMALL:
        # There cannot be more different n-grams than this, however long the log is.
        shares = F.broadcast(shares)
    covered = order.rowsBetween(-reach, 0)
    context = [F.lag("gram", k).over(order) if k else F.col("gram") for k in range(reach, -1, -1)]
    return (
        grams.join(shares, "gram", "left")
        .withColumn("anomaly_score", F.coalesce(F.avg(1 - F.col("share")).over(covered), F.lit(0.0)))
        .withColumn("pattern_info", F.array_join(F.slice(F.array_compact(F.array(*context)), 1, 2), "; "))
        .where("home")
        .select("source", "line_number", "anomaly_score", "pattern_info")
    )


def detect_sequences(
    df: DataFrame, length: int = 3, cut: float = 0.8, partitions: int | None = None
) -> DataFrame:
    scores = sequence_scores(df, length, partitions)
    return df.join(scores, ["source", "line_number"]).withColumn(
        "is_anomaly", (F.col("anomaly_score") > F.lit(cut)).cast("int")
    )

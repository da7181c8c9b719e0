"""Mixing sources to target weights by Pareto order sampling.

A source that is to give ``share`` times its size gives every document ``floor(share)`` whole
times for certain; what is left of the target is a sample without replacement. There a document's inclusion
probability is proportional to its size, at most 1, scaled so that the expected words are the words wanted; a document
longer than all that is wanted has none. Each document gets a random number ``u``, documents are ranked by the odds
of ``u`` divided by the odds of ``p``, and the first ones that fill the rest are taken, passing over those that no
longer fit. The random numbers are hashes of the
ids, so reruns agree.

Sizes are summed in ranges of the sorted rows; a source that holds a third of all rows is many
ranges. Targets and scales are solved by one aggregate a round over the tables of sources and sizes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import buffers, fresh, kept, one_row_each, stretches, sums_between, unit_interval, with_running_total, word_starts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = buffers(batch.column("text"))
        runs = [(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in stretches(at)]
        sizes = np.concatenate([np.zeros(0, np.int64), *(sums_between(word_starts(*run)[1], run[1]) for run in runs)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), pa.array(sizes)], names=["doc_id", "source", "size"]
        )


def word_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: words of each whole text (null: none), row by row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "source")
    return rows.mapInArrow(_count_words, "doc_id long, source string, size long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """``source, source_size, start, target``: the size of everything shared by weight, no source above ``most`` times its own.

    Sources stand in code point order, null last, and take the weights in turn. A source that would
    pass its limit stops there; the excess goes to the others by weight, until none is above.
    ``start`` is the size of all sources before this one.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    numbered = with_running_total(totals, ["last", "source"], "source_size", "sources")
    turn = F.array(*(F.lit(float(w)) for w in weights))
    numbered = kept(
        numbered.select(
            "source",
            "source_size",
            F.col("before").alias("start"),
            (most * F.col("source_size")).alias("limit"),
            F.get(turn, (F.col("position") % len(weights)).cast("int")).alias("weight"),
        ),
        "source-weights",
    )
    whole = float(numbered.agg(F.sum("source_size")).head()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        # One row: what stopped sources take, the weight of the others, and how many have stopped.
        full = F.col("limit") <= level * F.col("weight")
        row = numbered.agg(
            F.sum(F.when(full, F.col("limit"))).alias("taken"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).head()
        if not row["weight"] or row["n"] == stopped:
            break
        stopped = row["n"]
        level = (whole - (row["taken"] or 0.0)) / row["weight"]
    return numbered.select("source", "source_size", "start", F.least(F.col("limit"), level * F.col("weight")).alias("target"))


def pareto_rank(u: Column, p: Column) -> Column:
    """Odds of the random number by the odds of inclusion; smaller comes first."""
    return (u / (1 - u)) / (p / (1 - p))


def inclusion(rows: DataFrame, rounds: int = 30) -> DataFrame:
    """Adds ``p`` to rows with ``source, size, wanted``: min(1, c size) with sum of p size = wanted in each source.

    Rows longer than ``wanted`` have probability 0; if all others together do not exceed it, they have 1. Each round caps
    at least one more row or ends; should ``rounds`` not do, probabilities sum to a little less, which only moves the
    order of ranks.
    """
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("wanted"))
    scales, before = None, -1
    for _ in range(rounds):
        scaled = rows.where(fits) if scales is None else rows.where(fits).join(scales, F.col("source").eqNullSafe(F.col("of")))
        capped = F.lit(False) if scales is None else F.col("c") * F.col("size") >= 1
        sums = scaled.groupBy("source").agg(
            F.first("wanted").alias("wanted"),
            F.coalesce(F.sum(F.when(capped, F.col("size"))), F.lit(0)).alias("sure"),
            F.coalesce(F.sum(F.when(~capped, F.col("size").cast("double") * F.col("size"))), F.lit(0.0)).alias("squares"),
            F.count(F.when(capped, 1)).alias("n"),
        )
        left = F.greatest(F.col("wanted") - F.col("sure"), F.lit(0.0))
        c = F.when(F.col("squares") > 0, left / F.col("squares")).otherwise(F.lit(1.0))
        if scales is not None:  # a scale never falls, so what is capped stays capped
            sums = sums.join(scales.select("of", F.col("c").alias("c_before")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
            c = F.greatest(c, F.col("c_before"))
        scales = kept(sums.select(F.col("source").alias("of"), c.alias("c"), "n"), "scales")
        done = scales.agg(F.sum("n")).head()[0] or 0
        if done == before:
            break
        before = done
    p = F.when(fits, F.least(F.lit(1.0), F.coalesce("c", F.lit(0.0)) * F.col("size"))).otherwise(0.0)
    return rows.join(scales.select("of", "c"), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("p", p).drop("of", "c")


def mix(
    docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 17, near: float = 0.001
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``copies`` is how often the mix takes the document, ``taken`` its words times that. A source ends within half its
    last document of its target, or within ``near`` of it, unless all documents left are longer than that. Null texts
    and texts without a word have size 0 and take nothing. Rows that repeat an id are rows of
    their own. No rows in, no rows out; other columns are not read.
    """
    sizes = kept(word_sizes(docs), "sizes")
    targets = kept(source_targets(sizes, weights, most).withColumnRenamed("source", "named"), "targets")
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(share)).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = inclusion(kept(rows, "wanted"))
    # Odds of a probability at the rim are moved off it; sure rows are first all the same.
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    ranked = rows.withColumn("rank", pareto_rank(unit_interval(F.lit(seed), F.col("doc_id")), p)).withColumn("last", F.col("source").isNull())
    ordered = kept(with_running_total(ranked, ["last", "source", "rank", "doc_id", "size"], "size", "ranked"), "ordered")
    more = _filled(ordered.where("p > 0").select("position", "source", "size", "target", F.col("wanted").alias("left")), near)
    found = ordered.join(more.withColumnRenamed("position", "in_"), F.col("position") == F.col("in_"), "left")
    copies = (F.col("whole") + F.when(F.col("in_").isNotNull(), 1).otherwise(0)).cast("long")
    return found.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"),
        F.when(F.col("size") > 0, copies * F.col("size")).otherwise(0).cast("long").alias("taken"),
    )


def _filled(rows: DataFrame, near: float) -> DataFrame:
    """``position`` of the rows that fill what is ``left`` of each source, in the order of ``position``.

    A row is in while its middle lies below what is left. Behind a long row that does not fit, the search goes on among
    those that do; what is left at least halves each time, until it is below ``near`` of the target.
    """
    chosen, waiting = [], kept(rows, "waiting")
    while waiting.head(1):
        placed = with_running_total(waiting.withColumnRenamed("position", "id_"), ["id_"], "size", "filling").select("source", "size", "target", "left", "before", F.col("id_").alias("position"))
        starts = placed.groupBy("source").agg(F.min("before").alias("start")).withColumnRenamed("source", "of")
        inside = F.col("before") - F.col("start") + F.col("size") / 2 <= F.col("left")
        placed = kept(placed.join(starts, F.col("source").eqNullSafe(F.col("of"))).withColumn("inside", inside).drop("of", "start", "before"), "placed")
        chosen.append(placed.where("inside").select("position"))
        gone = placed.groupBy("source").agg(F.sum(F.when(F.col("inside"), F.col("size")).otherwise(0)).alias("gone")).withColumnRenamed("source", "of")
        rest = placed.where("NOT inside").join(gone, F.col("source").eqNullSafe(F.col("of"))).withColumn("left", F.col("left") - F.col("gone"))
        rest = rest.where((F.col("size") <= F.col("left")) & (F.col("left") > near * F.col("target")))
        waiting = kept(rest.select("position", "source", "size", "target", "left"), "waiting")
    if not chosen:
        return rows.select("position")
    found = chosen[0]
    for more in chosen[1:]:
        found = found.unionAll(more)
    return found


def mixed(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; of rows that repeat an id, one."""
    rows = one_row_each(docs)
    taken, copies, copy = fresh(docs, "taken", "copies", "copy")
    found = mix(rows, weights, most, seed).where("copies > 0")
    found = kept(found.select(F.col("doc_id").alias(taken), F.col("copies").alias(copies)), "mix")
    both = rows.join(found.hint("merge"), rows["doc_id"] == found[taken])
    return both.select(*(rows[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), found[copies])).alias(copy)).drop(copy)

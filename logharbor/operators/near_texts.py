"""Pairs of sparse unit vectors at a high cosine, by an equi-join on their rarest terms.

Terms are ordered from rare to frequent. If two vectors have a cosine of at least ``c``, their first common term in that
order lies in the head of both: the rest behind the head is shorter than ``c`` and cannot reach it alone. So only heads
are joined, and a pair counts where the joined term is its first common one. Vectors come with the box of their numeric
features; boxes too far apart are dropped before terms are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from logharbor.operators.term_space import TermSpace
from logharbor.session import durable, shuffled

#: Vectors under one term that one join key may hold.
_BLOCK = 2_000
_ARRANGED = "struct<idx: array<int>, val: array<double>, head: int>"


def rarest_first(df: DataFrame, space: TermSpace, known: str, least: float) -> Column:
    """Unit vectors of ``known_terms`` with terms numbered from rare to frequent, and ``head``: leading terms to join for
    cosines >= ``least``."""
    order = np.empty(space.size, np.int32)
    order[np.lexsort((np.arange(space.size), -space.idf))] = np.arange(space.size)
    shared = df.sparkSession.sparkContext.broadcast(order)

    @F.arrow_udf(_ARRANGED)
    def arrange(vectors: pa.Array) -> pa.Array:
        places, counts = vectors.field("idx"), pc.list_value_length(vectors.field("idx")).to_numpy(zero_copy_only=False)
        ranks = shared.value[places.flatten().to_numpy(zero_copy_only=False)]
        by_rank = np.lexsort((ranks, np.repeat(np.arange(len(counts)), counts)))
        ends = np.concatenate(([0], np.cumsum(counts)))
        weights = vectors.field("val").flatten().to_numpy(zero_copy_only=False)[by_rank]
        heads = np.zeros(len(counts), np.int32)
        # Vectors of one length together, so that equal ones are summed alike in whatever batch they come.
        for count in np.unique(counts[counts > 0]).tolist():
            at = np.flatnonzero(counts == count)
            some = weights[ends[at][:, None] + np.arange(count)]
            behind = np.cumsum((some * some)[:, ::-1], axis=1)[:, ::-1]
            heads[at] = (behind >= least * least - 1e-9).sum(axis=1)
        offsets = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (ranks[by_rank], weights)]
        return pa.StructArray.from_arrays([*lists, pa.array(heads)], names=["idx", "val", "head"])

    return arrange(space.vectors_of_known(df, known))


def box(d: int) -> list[Column]:
    """Aggregates: the least and greatest value of each coordinate of ``x``."""
    ends = [F.min(F.col("x")[i]).alias(f"lo{i}") for i in range(d)]
    return ends + [F.max(F.col("x")[i]).alias(f"hi{i}") for i in range(d)]


def _headings(vectors: DataFrame) -> DataFrame:
    """A row for each vector and term of its head, with the blocks that a term with many vectors is split into."""
    rows = vectors.select("*", F.explode(F.slice("_vector.idx", F.lit(1), F.col("_vector.head"))).alias("term"))
    sizes = rows.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("bigint").alias("blocks"))
    # At most one row for each word of the vocabulary, whose size is a parameter.
    return rows.join(F.broadcast(sizes), "term").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")))


def _cosine(a: Column, b: Column) -> Column:
    """Inner product of two arranged vectors; a message has few terms."""
    def step(total: Column, term: Column) -> Column:
        other = F.get(b["val"], (F.array_position(b["idx"], term["i"]) - 1).cast("int"))
        return total + F.coalesce(other * term["v"], F.lit(0.0))

    pairs = F.zip_with(a["idx"], a["val"], lambda i, v: F.struct(i.alias("i"), v.alias("v")))
    return F.aggregate(pairs, F.lit(0.0), step)


def near_vectors(vectors: DataFrame, d: int, eps: float) -> DataFrame:
    """``vid, near_vid, apart`` for vectors ``vid, _vector, lo0, hi0, ...`` within ``eps``, both ways and each with itself.

    ``apart`` is the squared distance. Pairs whose boxes leave no points within ``eps`` are not listed.
    """
    limit = eps * eps * (1 + 1e-12)
    headings = durable(_headings(vectors))
    number = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    # Block i meets block j under the key (i, j) with i <= j.
    left = headings.withColumn("j", F.explode(F.filter(number, lambda j: j >= F.col("block")))).withColumnRenamed("block", "i")
    right = headings.withColumn("i", F.explode(F.filter(number, lambda i: i <= F.col("block")))).withColumnRenamed("block", "j")
    ends = [f"{end}{k}" for end in ("lo", "hi") for k in range(d)]
    left = left.select("term", "i", "j", F.col("vid"), F.col("_vector").alias("u"), *ends)
    right = right.select(
        "term", "i", "j", F.col("vid").alias("near_vid"), F.col("_vector").alias("v"), *[F.col(c).alias(f"o_{c}") for c in ends]
    )
    # Inside one block each pair comes twice; between blocks once, in either order.
    met = shuffled(left).join(right, ["term", "i", "j"]).where((F.col("vid") != F.col("near_vid")) & ((F.col("i") < F.col("j")) | (F.col("vid") < F.col("near_vid"))))
    gap = F.lit(0.0)
    for k in range(d):
        apart = F.greatest(F.col(f"lo{k}") - F.col(f"o_hi{k}"), F.col(f"o_lo{k}") - F.col(f"hi{k}"), F.lit(0.0))
        gap = gap + apart * apart
    first = F.get(F.array_intersect(F.col("u.idx"), F.col("v.idx")), F.lit(0))
    judged = met.where(gap <= limit).select(
        "vid", "near_vid", "term", first.alias("first"), gap.alias("gap"),
        F.greatest(2 - 2 * _cosine(F.col("u"), F.col("v")), F.lit(0.0)).alias("apart"),
    )
    near = durable(judged.where((F.col("apart") + F.col("gap") <= limit) & (F.col("first") == F.col("term"))).select("vid", "near_vid", "apart"))
    back = near.select(F.col("near_vid").alias("vid"), F.col("vid").alias("near_vid"), "apart")
    own = vectors.select("vid", F.col("vid").alias("near_vid"), F.lit(0.0).alias("apart"))
    return near.unionByName(back).unionByName(own)

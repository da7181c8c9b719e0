"""Exact duplicates by block naming.

A text is cut into blocks of fixed size. All blocks are sorted and equal ones get one integer
name; then neighbouring names are paired, the pairs are sorted and named, and so on until one name
is left for each document. A name stands for exactly one string, so equal names of documents mean
equal texts, without any hash to trust.

A block that sits in a third of all rows stays cheap: a task first gathers the owners of a block in
its batch into one row, so each batch sends a block once, whatever the number of its owners.
Steps are written to shared storage and read again, names included.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import LOWER, buffers, kept, lean, one_row_each, one_text_each, without_ids

_OWNED = "item binary, doc_id array<long>, place array<long>, parts array<long>"
_NAMED = "doc_id long, place long, parts long, name long"


def _owned(items: Iterable[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
    """One row for each item with the lists of its owners."""
    owners: dict[bytes, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    for item, doc, place, parts in items:
        lists = owners[item]
        lists[0].append(doc)
        lists[1].append(place)
        lists[2].append(parts)
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(owners.keys(), pa.binary()), *(pa.array([x[i] for x in owners.values()], longs) for i in range(3))],
        names=["item", "doc_id", "place", "parts"],
    )


def _blocks(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            body = LOWER[data].tobytes()
            yield _owned(
                (body[start + size * place : min(end, start + size * (place + 1))], doc, place, parts)
                for doc, start, end in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist())
                for parts in [max(1, -(-(end - start) // size))]
                for place in range(parts)
            )

    return cut


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right, doc, place, parts = (np.asarray(batch.column(c)) for c in ("left", "right", "doc_id", "place", "parts"))
        body = np.stack([left, right], axis=1).astype(">i8").tobytes()
        yield _owned(
            (body[16 * i : 16 * i + 16], d, p, n) for i, (d, p, n) in enumerate(zip(doc.tolist(), place.tolist(), parts.tolist()))
        )


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names in sorted order; the number of the partition makes them unique over all of them."""
    from pyspark import TaskContext

    name, last = TaskContext.get().partitionId() << 40, None
    for batch in batches:
        names = []
        for item in batch.column("item").to_pylist():
            if item != last:
                name, last = name + 1, item
            names.append(name)
        counts = np.asarray(batch.column("doc_id").value_lengths())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).flatten() for c in ("doc_id", "place", "parts")), pa.array(np.repeat(np.array(names, np.int64), counts))],
            names=["doc_id", "place", "parts", "name"],
        )


def _named(owned: DataFrame) -> DataFrame:
    return kept(owned.repartition("item").sortWithinPartitions("item").mapInArrow(lean(_number), _NAMED), "names")


def document_names(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """``doc_id, level, name``: equal (level, name) means equal text once A-Z is in lower case."""
    level = _named(docs.mapInArrow(lean(_blocks(block_bytes)), _OWNED))
    most = level.agg(F.max("parts")).head()[0] or 1
    done, depth = [level.where("parts = 1").select("doc_id", F.lit(0).alias("level"), "name")], 0
    while most > 1:
        depth, most = depth + 1, -(-most // 2)
        half = (F.col("place") / 2).cast("long")
        pairs = (
            level.where("parts > 1")
            .groupBy("doc_id", half.alias("place"), F.expr("(parts + 1) div 2").alias("parts"))
            .agg(
                F.max(F.expr("CASE WHEN place % 2 = 0 THEN name END")).alias("left"),
                F.coalesce(F.max(F.expr("CASE WHEN place % 2 = 1 THEN name END")), F.lit(-1)).alias("right"),
            )
        )
        level = _named(pairs.mapInArrow(lean(_pairs), _OWNED))
        done.append(level.where("parts = 1").select("doc_id", F.lit(depth).alias("level"), "name"))
    names = done[0]
    for more in done[1:]:
        names = names.unionAll(more)
    return names


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = buffers(batch.column("text"))
        body = memoryview(LOWER[data].tobytes())
        hexes = [hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hexes, pa.string())], names=["doc_id", "text_sha256"])


def exact_groups(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every document.

    Texts are equal when identical after lower-casing A-Z; the largest doc_id of a group stays.
    Null and empty texts are equal to each other. Rows without an id are left out; of rows that
    repeat an id the greatest text counts. Other columns are not read. No rows in, no rows out.
    """
    rows = one_text_each(docs)
    names = document_names(rows, block_bytes)
    groups = kept(
        names.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"),
        "groups",
    )
    digests = rows.mapInArrow(lean(_digests), "doc_id long, text_sha256 string")
    found = names.join(groups, ["level", "name"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )
    return (
        found.join(digests, "doc_id")
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
    )


def without_copies(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_groups`` keeps; of rows that repeat an id, one."""
    rows = one_row_each(docs)
    return without_ids(rows, exact_groups(rows, block_bytes).where("NOT kept"))

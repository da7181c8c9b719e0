"""Merkle trees over groups of rows, with proofs by pointer jumping.

1. Rows are sorted into ranges by group and key; each range numbers its groups and the places inside them, and the driver
   adds what lies before a range: it sees the first and the last row of a range and nothing else.
2. Trees grow ten levels at a time: a block of 1,024 neighbouring nodes is a complete subtree, built in one step. A block
   hands on its top node; every node below keeps a *segment*, the one step to its parent: the digest and side of its
   sibling, or that it has none. A tree that is lower than the highest one is carried up by steps that change nothing, so
   all subroots stand on one level, and the tree over them continues the levels up to the root.
3. Pointer jumping: in round r every node on a level divisible by 2^(r+1) looks up the node 2^r levels above it, takes over
   that node's ancestor and appends its segment. Only levels divisible by the distance are ever asked again, so
   nodes thin out as segments grow, and after log2 of the height each leaf holds its whole proof.

No key is hot: a node has at most 2^d descendants d levels below it, and d = 32 is only reached when few nodes are left
to look up. Looked-up nodes are broadcast while there are at most ``_FEW`` of them, counted first; otherwise
both sides are shuffled. A group of a third of all rows is just more blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.llm.common import kept

#: Levels built in one step.
_STEP = 10
#: Looked-up nodes that may be broadcast; each has at most 33 bytes for each level.
_FEW = 4096
#: What a step does to a digest: it stands alone, its sibling follows or precedes it, or nothing changes.
ALONE, FOLLOWS, PRECEDES, SAME = 0, 1, 2, 3
_NODES = "kind int, tree long, level int, pos long, step binary, digest string"
_NODE, _NEXT, _TOP = 0, 1, 2


def digest_of(*columns: str) -> Column:
    """SHA-256 in hex of the named columns: each ``-`` if null, else its UTF-8 length, a colon and its value."""
    return F.sha2(F.concat(*map(_piece, columns)), 256)


def _piece(column: str | Column) -> Column:
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest_of_values(*values: Column) -> Column:
    """As ``digest_of``, for expressions."""
    return F.sha2(F.concat(*map(_piece, values)), 256)


def _joined(left: str, right: str = "") -> str:
    return hashlib.sha256((left + right).encode()).hexdigest()


def _numbered(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Adds ``tree`` (number of the group, in order) and ``pos`` (place in it); the number of groups and the largest size."""
    schema = T.StructType([*rows.schema.fields])
    for name in ("range_", "row_", "tree", "pos"):
        schema = schema.add(name, T.LongType())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, tree, pos, last = TaskContext.get().partitionId(), 0, 0, -1, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            code = np.asarray(batch.column("group").dictionary_encode().indices.fill_null(-1))
            begins = np.ones(n, bool)
            begins[1:] = code[1:] != code[:-1]
            first = batch.column("group")[0].as_py()
            begins[0] = row > 0 and first != last
            trees = tree + np.cumsum(begins)
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(begins, at, -1))
            places = np.where(start < 0, pos + 1 + at, at - start)
            columns = (np.full(n, part), np.arange(row, row + n), trees, places)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.astype(np.int64)) for c in columns)], names=schema.names)
            row, tree, pos, last = row + n, int(trees[-1]), int(places[-1]), batch.column("group")[n - 1].as_py()

    order = ["group", "key", *(c for c in rows.columns if c not in ("group", "key"))]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = kept(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(number, schema), "numbered")
    ends = (
        local.groupBy("range_")
        .agg(F.min_by("group", "row_").alias("first"), F.max_by(F.struct("group", "tree", "pos"), "row_").alias("last"))
        .orderBy("range_")
        .collect()
    )
    offsets, tree, pos, before = [], -1, -1, None
    for end in ends:
        same = tree >= 0 and end["first"] == before
        lift, ahead = (tree, pos + 1) if same else (tree + 1, 0)
        offsets.append((end["range_"], lift, ahead))
        last = end["last"]
        pos = last["pos"] + (ahead if last["tree"] == 0 else 0)
        tree, before = lift + last["tree"], last["group"]
    lifts = rows.sparkSession.createDataFrame(offsets or [(-1, 0, 0)], "range_ long, lift_ long, ahead_ long")
    numbered = local.join(F.broadcast(lifts), "range_").select(
        *rows.columns,
        (F.col("tree") + F.col("lift_")).alias("tree"),
        (F.col("pos") + F.when(F.col("tree") == 0, F.col("ahead_")).otherwise(0)).alias("pos"),
    )
    numbered = kept(numbered, "leaves")
    return numbered, tree + 1, (numbered.agg(F.max("pos")).head()[0] if offsets else -1) + 1


def _grown(base: int, top: int):
    """Nodes of subtrees from rows (tree, pos, digest) on level ``base``, sorted; finished trees are carried up to ``top``."""

    def build(tree: int, block: int, digests: list[str]) -> list[tuple]:
        rows, level, first, nodes = [], base, block << _STEP, digests
        whole = block == 0 and len(digests) < 1 << _STEP
        while level < base + _STEP and not (whole and len(nodes) == 1):
            above = []
            for i in range(0, len(nodes), 2):
                if i + 1 < len(nodes):
                    rows.append((_NODE, tree, level, first + i, bytes([FOLLOWS]) + bytes.fromhex(nodes[i + 1]), None))
                    rows.append((_NODE, tree, level, first + i + 1, bytes([PRECEDES]) + bytes.fromhex(nodes[i]), None))
                    above.append(_joined(nodes[i], nodes[i + 1]))
                else:
                    rows.append((_NODE, tree, level, first + i, bytes([ALONE]), None))
                    above.append(_joined(nodes[i]))
            level, first, nodes = level + 1, first >> 1, above
        if whole:
            rows += [(_NODE, tree, k, 0, bytes([SAME]), None) for k in range(level, top)]
            rows.append((_TOP, tree, level, 0, None, nodes[0]))
        else:
            rows.append((_NEXT, tree, level, first, None, nodes[0]))
        return rows

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "tree", "level", "pos", "step", "digest"]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
        current, held, out = None, [], []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            trees, places = batch.column("tree").to_pylist(), batch.column("pos").to_pylist()
            for tree, pos, digest in zip(trees, places, batch.column("digest").to_pylist()):
                if (tree, pos >> _STEP) != current:
                    if held:
                        out += build(*current, held)
                        if len(out) > 20_000:
                            yield batch_of(out)
                            out = []
                    current, held = (tree, pos >> _STEP), []
                held.append(digest)
        if held:
            out += build(*current, held)
        if out:
            yield batch_of(out)

    return grow


def _trees(level: DataFrame, size: int, base: int, top: int) -> tuple[DataFrame, DataFrame]:
    """All nodes with their steps, and the tops, of trees over rows (tree, pos, digest) of at most ``size`` leaves."""
    nodes, tops = [], []
    while True:
        sorted_ = level.repartition("tree", F.shiftright("pos", _STEP)).sortWithinPartitions("tree", "pos")
        built = kept(sorted_.mapInArrow(_grown(base, top), _NODES), "nodes")
        nodes.append(built.where(f"kind = {_NODE}").select("tree", "level", "pos", F.col("step").alias("steps")))
        tops.append(built.where(f"kind = {_TOP}").select("tree", "digest"))
        if size < 1 << _STEP:
            break
        level = built.where(f"kind = {_NEXT}").select("tree", "pos", "digest")
        size, base = -(-size >> _STEP), base + _STEP
    return _all(nodes), _all(tops)


def _all(frames: list[DataFrame]) -> DataFrame:
    found = frames[0]
    for more in frames[1:]:
        found = found.unionAll(more)
    return found


def _height(size: int) -> int:
    return max(0, size - 1).bit_length()


def manifest(rows: DataFrame) -> tuple[DataFrame, str | None, int]:
    """``rows`` with ``steps``, the proof of each; the root; and the height of the level of subroots.

    ``rows`` has ``group``, ``key``, ``leaf`` (digest in hex) and any other columns. In each group the leaves stand in
    ascending order of ``key``, null first, ties in order of the other columns, so repeated rows are
    leaves of their own. While several nodes remain, every two neighbours, and a last one alone, become the digest of
    their hex texts; subroots, in order of ``group`` (null first, by bytes), are joined in the same way. The proof
    of a leaf is a sequence of steps, see ``folded``. A group or a table of one row has steps that change nothing
    or none. Without rows there is no root.
    """
    numbered, trees, size = _numbered(rows)
    if not trees:
        return numbered.drop("tree", "pos").withColumn("steps", F.lit(b"")), None, 0
    low, top = _height(size), _height(size) + _height(trees)
    nodes, subroots = _trees(numbered.select("tree", "pos", F.col("leaf").alias("digest")), size, 0, low)
    upper, root = _trees(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest"), trees, low, top)
    nodes = kept(nodes.unionAll(upper), "steps")
    # From here on a leaf is a node of level 0 that carries the columns of its row.
    payload = [c for c in numbered.columns if c not in ("tree", "pos")]
    at_once = (F.col("n.tree") == (F.col("l.tree") if low else F.lit(0))) & (F.col("n.pos") == F.col("l.pos" if low else "l.tree"))
    leaves = numbered.alias("l")
    if top:
        leaves = leaves.join(nodes.where("level = 0").alias("n"), at_once).select("l.*", F.col("n.steps"))
    else:
        leaves = leaves.select("l.*", F.lit(b"").alias("steps"))
    leaves = leaves.withColumn("level", F.lit(0))
    inner, distance = nodes.where("level > 0"), 1
    while distance < top:
        asked = f"level % {2 * distance} = {distance}"
        above = inner.where(asked).select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("pos").alias("up_pos"), F.col("steps").alias("more"))
        few = above.limit(_FEW + 1).count() <= _FEW
        leaves = kept(_jump(leaves, above, distance, low, top, few), "proofs")
        rest = inner.where(f"level % {2 * distance} = 0")
        inner = kept(_jump(rest, above, distance, low, top, few), "segments")
        distance *= 2
    return leaves.select(*payload, "steps"), root.head()["digest"], low


def _jump(nodes: DataFrame, above: DataFrame, distance: int, low: int, top: int, few: bool) -> DataFrame:
    """Appends to each node's segment the segment of the node ``distance`` levels above; nodes already at the root stay."""
    level = F.col("level") + distance
    inside, crossing = level < low, F.col("level") < low
    up_tree = F.when(inside, F.col("tree")).otherwise(F.lit(0).cast("long"))
    climbed = F.expr(f"shiftright(tree, CAST(level + {distance - low} AS INT))")
    up_pos = F.when(~inside & crossing, climbed).otherwise(F.shiftright("pos", distance))
    # A leaf whose tree is no taller than level 0 stands in the tree over the groups at once.
    if low == 0:
        up_pos = F.when(F.col("level") == 0, F.expr(f"shiftright({'tree' if 'leaf' in nodes.columns else 'pos'}, {distance})")).otherwise(F.shiftright("pos", distance))
    placed = nodes.select("*", up_tree.alias("t_"), level.cast("int").alias("l_"), up_pos.alias("p_"))
    right = F.broadcast(above) if few else above
    joined = placed.where(level < top).join(right, (F.col("t_") == F.col("up_tree")) & (F.col("l_") == F.col("up_level")) & (F.col("p_") == F.col("up_pos")))
    joined = joined.withColumn("steps", F.concat("steps", "more")).select(*nodes.columns)
    return joined.unionAll(nodes.where(level >= top))


def _parsed(steps: bytes) -> Iterator[tuple[int, str]]:
    at = 0
    while at < len(steps):
        kind = steps[at]
        wide = 32 if kind in (FOLLOWS, PRECEDES) else 0
        yield kind, steps[at + 1 : at + 1 + wide].hex()
        at += 1 + wide


def fold(digest: str, steps: bytes) -> Iterator[str]:
    """The digests from a leaf upwards, one after each step."""
    for kind, sibling in _parsed(steps):
        if kind == ALONE:
            digest = _joined(digest)
        elif kind == FOLLOWS:
            digest = _joined(digest, sibling)
        elif kind == PRECEDES:
            digest = _joined(sibling, digest)
        yield digest


def folded(proofs: DataFrame, low: int) -> DataFrame:
    """Adds to ``leaf, shown, steps`` the ``siblings`` (array of hex digests, from the leaf to the root), the
    ``subroot`` the leaf leads to and ``folded_root``, the root that ``shown`` leads to by the same steps."""
    schema = T.StructType([*proofs.schema.fields])
    schema = schema.add("siblings", T.ArrayType(T.StringType())).add("subroot", T.StringType()).add("folded_root", T.StringType())

    def fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            siblings, subroots, roots = [], [], []
            for leaf, shown, steps in zip(*(batch.column(c).to_pylist() for c in ("leaf", "shown", "steps"))):
                siblings.append([s for _, s in _parsed(steps) if s])
                path = [leaf, *fold(leaf, steps)]
                subroots.append(path[low])
                roots.append(path[-1] if shown == leaf else [shown, *fold(shown, steps)][-1])
            columns = [pa.array(siblings, pa.list_(pa.string())), pa.array(subroots, pa.string()), pa.array(roots, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return proofs.mapInArrow(fold_all, schema)


def document_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, siblings, folded_root, verified`` for every row of ``docs``, one tree for each ``lang``.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Where 7 divides the CRC-32 of the decimal
    doc_id, the row is shown with n_chars one higher; ``folded_root`` is the root its shown leaf leads to by the
    stored proof. Nulls in any column are part of the leaf; rows without an id are leaves before all others and are
    never changed. Repeated rows are leaves of their own. Other columns are not read. No rows in, no rows out.
    """
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    more = F.when(changed, F.try_add(F.col("n_chars").cast("long"), F.lit(1))).otherwise(F.col("n_chars").cast("long"))
    rows = docs.select(
        F.col("lang").alias("group"),
        F.col("doc_id").cast("long").alias("key"),
        digest_of("doc_id", "source", "lang", "n_chars", "text").alias("leaf"),
        digest_of_values(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")).alias("shown"),
    )
    proofs, root, low = manifest(kept(rows, "digests"))
    found = folded(proofs, low)
    return found.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        F.lit(root).cast("string").alias("root"),
        "siblings",
        "folded_root",
        (F.col("folded_root") == F.lit(root).cast("string")).alias("verified"),
    )

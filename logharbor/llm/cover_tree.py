"""Exact near-duplicate vectors by dual traversal of cover trees.

Equal vectors are counted as one with a weight. The distinct ones, at unit length, are sorted by the
nearest of a bounded number of pivots and cut into blocks of equal size, so a crowded place is just
more blocks. Each block gets a cover tree: levels of nodes with halving radii, every node inside its
parent, with the true covering radius of its members.

Two blocks meet if the bounds of their roots allow a pair within the threshold. Their trees are walked
together level by level: a pair of nodes is dropped when the distance of the centres less both radii
is beyond the threshold, counted as a whole when the distance plus both radii is within, and opened
otherwise. Pairs of single vectors are checked in double precision. A meeting of blocks returns, for
each vector, how many it links with and one link of a spanning forest, never the pairs themselves.

Where vectors point in random directions of many dimensions, no bound prunes much, and the work nears
that of all blocks against all blocks, a matrix product each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.llm.common import kept, smallest_reachable, with_running_total
from logharbor.operators.density import connected_components

_SLACK = 1e-9
_LEVELS = "array<struct<starts:array<int>,centres:array<int>,radii:array<double>>>"


def _units(values: np.ndarray) -> np.ndarray:
    """Rows at length 1; the largest entry goes out first, so squares neither overflow nor vanish."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values**2).sum(axis=1, keepdims=True))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors end in zeros."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def build_tree(points: np.ndarray, smallest: float, radius: float = 1.0) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Order of the points and levels (starts, centres, radii): nodes are stretches of the order.

    The first level has ``radius``, each next one half of that, down to ``smallest``; a level without a
    new node is left out.
    """
    n = len(points)
    near = (points @ points.T).astype(np.float32)
    node, centres = np.zeros(n, np.int64), np.zeros(1, np.int64)
    levels: list[tuple[np.ndarray, np.ndarray]] = []

    def reach(owner: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((points - points[owner]) ** 2).sum(axis=1), 0))

    distance = reach(centres[node])
    while True:
        cosine = 1 - radius * radius / 2
        new_node, new_centres = np.empty(n, np.int64), []
        wide = np.zeros(len(centres), bool)
        np.logical_or.at(wide, node, distance > radius)
        order = np.argsort(node, kind="stable")
        bounds = np.searchsorted(node[order], np.arange(len(centres) + 1))
        for number, centre in enumerate(centres):
            members = order[bounds[number] : bounds[number + 1]]
            if not wide[number]:
                new_node[members] = len(new_centres)
                new_centres.append(centre)
                continue
            first = centre
            while len(members):
                inside = near[first, members] >= cosine
                inside[members == first] = True
                new_node[members[inside]] = len(new_centres)
                new_centres.append(first)
                members = members[~inside]
                first = members[0] if len(members) else -1
        if len(new_centres) > len(centres) or not levels:
            levels.append((new_node.copy(), np.array(new_centres)))
        node, centres = new_node, np.array(new_centres)
        distance = reach(centres[node])
        if radius <= smallest or not (distance > 0).any():
            break
        radius /= 2
    order = np.lexsort(tuple(level for level, _ in reversed(levels)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    found = []
    for level, centre in levels:
        starts = np.searchsorted(level[order], np.arange(len(centre)))
        radii = np.maximum.reduceat(reach(centre[level])[order], starts)
        found.append((starts, place[centre], radii))
    return order, found


class _Tree:
    def __init__(self, vectors: np.ndarray, weights: np.ndarray, levels: list) -> None:
        self.points, self.weights = _units(vectors), weights
        self.total = np.concatenate(([0], np.cumsum(weights)))
        self.levels = [
            (np.append(np.asarray(x["starts"], np.int64), len(vectors)), np.asarray(x["centres"], np.int64), np.asarray(x["radii"], np.float64))
            for x in levels
        ]

    def level(self, depth: int):
        return self.levels[min(depth, len(self.levels) - 1)]

    def opened(self, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 child of nodes, on the next level."""
        starts, below = self.level(depth)[0], self.level(depth + 1)[0]
        return np.searchsorted(below, starts[nodes]), np.searchsorted(below, starts[nodes + 1])


def _products(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs between two stretches, for many pairs of stretches at once."""
    wide = second[1] - second[0]
    count = (first[1] - first[0]) * wide
    owner = np.repeat(np.arange(len(count)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return first[0][owner] + inner // wide[owner], second[0][owner] + inner % wide[owner]


def _pieces(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], chunk: int):
    """Pairs of stretches, with the first stretch cut wherever the pair alone has more than ``chunk`` products."""
    rows = np.maximum(chunk // np.maximum(second[1] - second[0], 1), 1)
    count = np.maximum(-(-(first[1] - first[0]) // rows), 1)
    owner = np.repeat(np.arange(len(count)), count)
    begin = first[0][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * rows[owner]
    return (begin, np.minimum(begin + rows[owner], first[1][owner])), (second[0][owner], second[1][owner])


def _meet(a: _Tree, b: _Tree, at_least: float, same: bool, chunk: int = 2_000_000):
    """Links of the points of ``a`` and of ``b``, and pairs of a graph with the same components."""
    limit = float(np.sqrt(2 - 2 * at_least))
    links_a, links_b = np.zeros(len(a.points), np.int64), np.zeros(len(b.points), np.int64)
    forest: list[tuple[np.ndarray, np.ndarray]] = []

    def whole(depth: int, i: np.ndarray, j: np.ndarray) -> None:
        """Node pairs that are within the limit throughout."""
        starts_a, centre_a, _ = a.level(depth)
        starts_b, centre_b, _ = b.level(depth)
        size_b = b.total[starts_b[j + 1]] - b.total[starts_b[j]]
        size_a = a.total[starts_a[i + 1]] - a.total[starts_a[i]]
        add = np.zeros(len(a.points) + 1, np.int64)
        np.add.at(add, starts_a[i], size_b)
        np.add.at(add, starts_a[i + 1], -size_b)
        links_a[:] += np.cumsum(add)[:-1]
        if same:
            own = i == j
            for node in i[own]:
                links_a[starts_a[node] : starts_a[node + 1]] -= a.weights[starts_a[node] : starts_a[node + 1]]
        else:
            add = np.zeros(len(b.points) + 1, np.int64)
            np.add.at(add, starts_b[j], size_a)
            np.add.at(add, starts_b[j + 1], -size_a)
            links_b[:] += np.cumsum(add)[:-1]
        for x, y in zip(i, j):
            forest.append((np.arange(starts_a[x], starts_a[x + 1]), np.full(starts_a[x + 1] - starts_a[x], centre_b[y])))
            forest.append((np.full(starts_b[y + 1] - starts_b[y], centre_a[x]), np.arange(starts_b[y], starts_b[y + 1])))

    def walk(depth: int, i: np.ndarray, j: np.ndarray) -> None:
        """Opens node pairs of a level that the bounds leave undecided, a bounded number at a time."""
        last = depth >= max(len(a.levels), len(b.levels)) - 1
        if last:
            first = (a.level(depth)[0][i], a.level(depth)[0][i + 1])
            second = (b.level(depth)[0][j], b.level(depth)[0][j + 1])
        else:
            first, second = a.opened(depth, i), b.opened(depth, j)
        first, second = _pieces(first, second, chunk)
        work = np.cumsum((first[1] - first[0]) * (second[1] - second[0]))
        cuts = np.searchsorted(work, np.arange(chunk, (work[-1] if len(work) else 0) + chunk, chunk)) + 1
        # Every slice begins where the one before ended: each piece is in exactly one.
        bounds = np.unique(np.concatenate(([0], np.minimum(cuts, len(work)), [len(work)])))
        for low, high in zip(bounds[:-1], bounds[1:]):
            x, y = _products((first[0][low:high], first[1][low:high]), (second[0][low:high], second[1][low:high]))
            if last:
                points(x, y)
            else:
                decide(depth + 1, x, y)

    def points(x: np.ndarray, y: np.ndarray) -> None:
        for low in range(0, len(x), 200_000):
            p, q = x[low : low + 200_000], y[low : low + 200_000]
            close = np.einsum("nd,nd->n", a.points[p], b.points[q]) >= at_least
            if same:
                close &= p != q
            p, q = p[close], q[close]
            links_a[:] += np.bincount(p, b.weights[q], len(a.points)).astype(np.int64)
            if not same:
                links_b[:] += np.bincount(q, a.weights[p], len(b.points)).astype(np.int64)
            forest.append((p, q))

    def decide(depth: int, i: np.ndarray, j: np.ndarray) -> None:
        _, centre_a, radius_a = a.level(depth)
        _, centre_b, radius_b = b.level(depth)
        keep: list[tuple[np.ndarray, np.ndarray]] = []
        for low in range(0, len(i), 200_000):
            p, q = i[low : low + 200_000], j[low : low + 200_000]
            distance = np.sqrt(((a.points[centre_a[p]] - b.points[centre_b[q]]) ** 2).sum(axis=1))
            settle(depth, p, q, distance, radius_a[p] + radius_b[q], keep)
        for p, q in keep:
            walk(depth, p, q)

    def settle(depth, p, q, distance, radii, keep) -> None:
        inside = distance + radii <= limit - _SLACK
        if inside.any():
            whole(depth, p[inside], q[inside])
        undecided = ~inside & (distance - radii <= limit + _SLACK)
        if undecided.any():
            keep.append((p[undecided], q[undecided]))

    _, centre_a, radius_a = a.level(0)
    _, centre_b, radius_b = b.level(0)
    # Centres c, d may have a pair below them if c.d >= 1 - (limit + r + s)^2 / 2. The square comes apart into what r has
    # alone and a product of r and s, so one product of matrices in single precision, with room for its rounding, leaves
    # few pairs of nodes to settle in double precision.
    far = limit + radius_a + 1e-6
    left = np.column_stack([a.points[centre_a], far, np.ones(len(far))]).astype(np.float32)
    right = np.column_stack([b.points[centre_b], radius_b, radius_b * radius_b / 2]).astype(np.float32).T
    least = (1 - far * far / 2 - 1e-5 - 1e-6 * left.shape[1]).astype(np.float32)
    for low in range(0, len(centre_a), 512):
        found = np.flatnonzero(left[low : low + 512] @ right >= least[low : low + 512, None])
        for part in range(0, len(found), 200_000):
            p, q = np.divmod(found[part : part + 200_000], len(centre_b))
            p += low
            keep: list[tuple[np.ndarray, np.ndarray]] = []
            distance = np.sqrt(((a.points[centre_a[p]] - b.points[centre_b[q]]) ** 2).sum(axis=1))
            settle(0, p, q, distance, radius_a[p] + radius_b[q], keep)
            for x, y in keep:
                walk(0, x, y)
    return links_a, links_b, forest


def near_vectors(rows: DataFrame, at_least: float = 0.95, block: int = 4096, pivots: int = 256, seed: int = 3) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector of ``rows`` (``vec_id, embedding``).

    Vectors link when their cosine, in double precision, is ``at_least``. Null, empty and zero vectors
    and those with null or non-finite entries link with nothing and keep their own id. Shorter vectors
    count as if they ended in zeros. Rows without an id are left out; of rows that repeat an id the
    greatest vector counts. Other columns are not read. No rows in, no rows out.
    """
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL")
    if given.groupBy("vec_id").count().where("count > 1").limit(1).count():
        given = given.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    sound = (
        F.coalesce(F.size("embedding") > 0, F.lit(False))
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    marked = given.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = kept(
        marked.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "classes"
    )
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).head()
    repeated = classes.where("weight > 1").select(F.col("embedding").alias("vector"), F.col("node").alias("first"))
    mine = (
        marked.join(repeated, F.col("embedding") == F.col("vector"), "left")
        .select("vec_id", F.coalesce("first", "vec_id").alias("node"))
    )
    found = _class_links(classes, int(size["n"]), int(size["width"] or 0), at_least, block, pivots, seed)
    return mine.join(found, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def _class_links(classes: DataFrame, count: int, width: int, at_least: float, block: int, pivots: int, seed: int) -> DataFrame:
    """``node, n_links, component_id`` of the classes that link with anything or have copies."""
    spark = classes.sparkSession
    if not count:
        return spark.createDataFrame([], "node long, n_links long, component_id long")
    exact = isinstance(classes.schema["embedding"].dataType.elementType, T.DoubleType)
    dtype = np.float64 if exact else np.float32
    chosen = classes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(min(pivots, -(-count // 1024)))
    middle = _units(np.stack([np.pad(np.array(r["embedding"], dtype), (0, width - len(r["embedding"]))) for r in chosen.collect()]))
    nearest_schema = T.StructType([*classes.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = _units(_rows(batch.column("embedding"), width)) @ middle.T
            cell = cosine.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(-cosine[np.arange(len(cell)), cell])],
                names=nearest_schema.names,
            )

    placed = with_running_total(classes.mapInArrow(nearest, nearest_schema), ["cell", "near", "node"], "weight", "cells")
    smallest = float(np.sqrt(2 - 2 * at_least)) / 8

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        vectors = np.stack([np.pad(np.asarray(v, dtype), (0, width - len(v))) for v in group["embedding"]])
        points = _units(vectors)
        # No node wider than the limit is ever counted as a whole.
        order, levels = build_tree(points, smallest, 8 * smallest)
        centre = points.mean(axis=0)
        return pd.DataFrame(
            {
                "block": [int(group["block"].iloc[0])],
                "centre": [centre],
                "radius": [float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))],
                "nodes": [group["node"].to_numpy(np.int64)[order].tobytes()],
                "weights": [group["weight"].to_numpy(np.int64)[order].tobytes()],
                "vectors": [vectors[order].tobytes()],
                "levels": [[{"starts": s.astype(np.int32), "centres": c.astype(np.int32), "radii": r} for s, c, r in levels]],
            }
        )

    tree_type = f"nodes binary, weights binary, vectors binary, levels {_LEVELS}"
    blocks = kept(
        placed.withColumn("block", F.floor(F.col("position") / block).cast("int"))
        .groupBy("block")
        .applyInPandas(grow, f"block int, centre array<double>, radius double, {tree_type}"),
        "trees",
    )
    roots = kept(blocks.select("block", "centre", "radius"), "roots")
    other = roots.select(F.col("block").alias("other"), F.col("centre").alias("other_centre"), F.col("radius").alias("other_radius"))
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "other_centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    limit = float(np.sqrt(2 - 2 * at_least)) + 1e-6
    meetings = (
        roots.select("*", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("other"))
        .join(other, "other")
        .where(apart <= F.col("radius") + F.col("other_radius") + limit)
        .select("block", "other")
    )
    left = blocks.select("block", *(F.col(c).alias(f"{c}_a") for c in ("nodes", "weights", "vectors", "levels")))
    right = blocks.select(F.col("block").alias("other"), *(F.col(c).alias(f"{c}_b") for c in ("nodes", "weights", "vectors", "levels")))

    def tree(batch: pa.RecordBatch, number: int, side: str) -> tuple[np.ndarray, _Tree]:
        nodes, weights = (np.frombuffer(batch.column(f"{c}_{side}")[number].as_buffer(), np.int64) for c in ("nodes", "weights"))
        vectors = np.frombuffer(batch.column(f"vectors_{side}")[number].as_buffer(), dtype).reshape(len(nodes), width)
        levels = batch.column(f"levels_{side}")[number].values
        stretches = [{c: levels.field(c)[at].values.to_numpy() for c in ("starts", "centres", "radii")} for at in range(len(levels))]
        return nodes, _Tree(vectors, weights, stretches)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                (nodes_a, a), (nodes_b, b) = tree(batch, number, "a"), tree(batch, number, "b")
                same = batch.column("block")[number].as_py() == batch.column("other")[number].as_py()
                links_a, links_b, forest = _meet(a, b, at_least, same)
                if same:
                    names, links, pairs = nodes_a, links_a, forest
                else:
                    names, links = np.concatenate((nodes_a, nodes_b)), np.concatenate((links_a, links_b))
                    pairs = [(x, y + len(nodes_a)) for x, y in forest]
                label = smallest_reachable(names, pairs)
                some = (links > 0) | (label != names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[some]), pa.array(links[some]), pa.array(label[some])], names=["node", "links", "root"]
                )

    met = kept(
        meetings.join(left, "block").join(right, "other").mapInArrow(meet, "node long, links long, root long"), "links"
    )
    edges = met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    linked = kept(met.groupBy("node").agg(F.sum("links").alias("links")), "linked")
    ends = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node"))).distinct()
    labels = connected_components(kept(ends, "ends"), edges)
    return (
        classes.select("node", "weight")
        .join(linked, "node", "left")
        .join(labels, "node", "left")
        .select(
            "node",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("label", "node").alias("component_id"),
        )
    )

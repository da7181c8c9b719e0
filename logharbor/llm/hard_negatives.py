"""Hard negatives by an inverted multi-index over integer vectors.

1. Each half of a vector has a codebook, fitted by k-means on a bounded sample of rows; a pair of codewords is a cell.
   All rows are filed: they are sorted by cell and cut into shelves of bounded size, so a cell that holds a third of
   all rows spans many shelves. Codewords know the radius of the half-vectors filed under them.
2. An anchor's product with a row is the sum over the halves, and in each half at most its product with the codeword plus
   its norm times the radius. A heap over the two lists, sorted by these bounds, names cells in the order of the sum.
3. Anchors visit cells in windows of growing width: shelves get the anchors that ask for one of their cells and answer
   with the best few rows for each. After a window the bound of the next cell certifies what has been found, or not; what
   is certified leaves. First the best rows of the same label are found, then, for each of their scores, the best rows of
   other labels in the window of scores that belongs to it.

Every row can be reached, so results are exact; in many dimensions bounds prune little, and the visit then covers most
cells. A shelf's rows and a slice of its anchors are held at a time; crowded shelves are dealt to several tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logharbor.llm.common import kept, with_running_total

#: Rows codebooks are fitted on, at most.
FIT_ROWS = 20_000
_MOST_WORDS = 64
#: Rows of a shelf, at most; fewer while there are not enough shelves for many tasks.
_SHELF = 8192
_SLICE = 256


@dataclass
class Codebooks:
    """Codewords of both halves, radii of what is filed under them, and where the cells are."""

    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    #: For each cell that has rows its first and last shelf.
    shelves: dict[int, tuple[int, int]]

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.words[0].shape[1]
        return vectors[:, :cut], vectors[:, cut:]

    def bounds(self, vector: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half the greatest and least product with a row filed under each codeword."""
        found = []
        for half, words, radii in zip(self.halves(vector[None, :]), self.words, self.radii):
            middle, slack = words @ half[0], np.linalg.norm(half[0]) * radii
            slack = slack + 1e-3 + 1e-9 * (np.abs(middle) + slack)
            found.append((middle + slack, middle - slack))
        return found

    def in_order(self, bounds) -> Iterator[tuple[float, int]]:
        """Cells that have rows with the bound of their scores, greatest bound first."""
        (first, _), (second, _) = bounds
        order_a, order_b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        a, b = first[order_a], second[order_b]
        heap, width = [(-(a[0] + b[0]), 0, 0)], len(self.words[1])
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = int(order_a[i]) * width + int(order_b[j])
            if cell in self.shelves:
                yield -bound, cell
            # Each pair is reached once: along j from everywhere, along i from the first column only.
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


def _k_means(points: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """Codewords of a bounded sample; seeds are spread evenly over the sample, which comes in order of a hash."""
    centres = points[np.linspace(0, len(points) - 1, words).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(points, centres)[0]
        count = np.bincount(near, minlength=words)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T
    near = square.argmin(axis=1)
    return near, np.linalg.norm(points - centres[near], axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width).astype(np.float64)


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows that take part and the length of their vectors.

    Left out: null ids, labels and vectors, vectors with a null component or none at all, and vectors of another length
    than most (the shorter one on a tie). Of rows that repeat an id the greatest (vector, label) stays.
    """
    sound = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)")
    usual = sound.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").head()
    width = usual["width"] if usual else 1
    sound = sound.where(F.size("vector") == width)
    if sound.groupBy("vec_id").count().where("count > 1").limit(1).count():
        best = F.max(F.struct("vector", *(c for c in sound.columns if c not in ("vec_id", "vector")))).alias("best")
        sound = sound.groupBy("vec_id").agg(best).select("vec_id", "best.*").select(*rows.columns)
    return sound, width


def build_index(rows: DataFrame, width: int, codewords: int | None = None, shelf_rows: int | None = None) -> tuple[DataFrame, Codebooks]:
    """Stored ``vec_id, label, vector, cell, shelf`` of all rows and the codebooks.

    ``codewords`` for each half: by default the root of a 200th of the rows, between 2 and 64. Codebooks are fitted on
    the ``FIT_ROWS`` rows with the least hash of their id.
    """
    rows = kept(rows.select("vec_id", "label", "vector"), "vectors")
    count = rows.count()
    words = codewords or int(min(_MOST_WORDS, max(2, (count / 200) ** 0.5)))
    shelf_rows = shelf_rows or min(_SHELF, max(_SHELF // 16, count // 64))
    sample = rows.select(F.xxhash64("vec_id").alias("draw"), "vec_id", "vector").orderBy("draw", "vec_id").limit(FIT_ROWS).toArrow()
    points = _matrix(sample.column("vector").combine_chunks(), width) if len(sample) else np.zeros((1, width))
    cut = width // 2
    centres = [_k_means(points[:, part], words) for part in (slice(0, cut), slice(cut, width))]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), width)
            (a, near_a), (b, near_b) = _nearest(vectors[:, :cut], centres[0]), _nearest(vectors[:, cut:], centres[1])
            columns = [pa.array((a * words + b).astype(np.int32)), pa.array(near_a), pa.array(near_b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "cell", "near_a", "near_b"])

    filed = rows.mapInArrow(file, "vec_id long, label long, vector array<double>, cell int, near_a double, near_b double")
    filed = with_running_total(filed, ["cell", "vec_id"], "cell", "filed").withColumn("shelf", F.floor(F.col("position") / shelf_rows).cast("long"))
    filed = kept(filed.drop("position", "before"), "shelves")
    radii = []
    for near, code in (("near_a", F.floor(F.col("cell") / words)), ("near_b", F.col("cell") % words)):
        radius = np.zeros(words)
        for row in filed.groupBy(code.cast("int").alias("code")).agg(F.max(near).alias("radius")).collect():  # at most _MOST_WORDS
            radius[row["code"]] = row["radius"]
        radii.append(radius)
    cells = filed.groupBy("cell").agg(F.min("shelf").alias("first"), F.max("shelf").alias("last")).collect()  # at most _MOST_WORDS ** 2
    return filed.drop("near_a", "near_b"), Codebooks(tuple(centres), tuple(radii), {c["cell"]: (c["first"], c["last"]) for c in cells})


def _planned(books, window: int, width: int):
    """Which cells anchors visit next, shelf by shelf, and the bound of the cell after those.

    ``lows`` and ``highs`` are the windows of scores an anchor still looks in: the visit ends below the least low, and
    cells whose scores are all above the greatest high are passed over.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, visited = batch.column("anchor_id").to_pylist(), batch.column("visited").to_pylist()
            lows, highs = (batch.column(c).to_pylist() for c in ("lows", "highs"))
            vectors = _matrix(batch.column("vector"), width)
            row, shelf, cells, bound_after = [], [], [], []
            for i in range(len(ids)):
                bounds = books.value.bounds(vectors[i])
                low, high = (min(lows[i]), max(highs[i])) if lows[i] else (-np.inf, np.inf)
                asked: dict[int, list[int]] = {}
                after = -np.inf
                for rank, (bound, cell) in enumerate(books.value.in_order(bounds)):
                    if rank < visited[i]:
                        continue
                    if rank >= visited[i] + window or bound < low:
                        after = bound
                        break
                    a, b = divmod(cell, len(books.value.words[1]))
                    if bounds[0][1][a] + bounds[1][1][b] <= high:
                        for s in range(books.value.shelves[cell][0], books.value.shelves[cell][1] + 1):
                            asked.setdefault(s, []).append(cell)
                # An anchor with nothing left to visit still says what its bound is.
                for s in asked or {-1: []}:
                    row.append(i)
                    shelf.append(s)
                    cells.append(asked.get(s, []))
                    bound_after.append(after)
            taken = batch.take(pa.array(row, pa.int64())) if row else batch.slice(0, 0)
            columns = [pa.array(shelf, pa.int64()), pa.array(cells, pa.list_(pa.int32())), pa.array(bound_after, pa.float64())]
            yield pa.RecordBatch.from_arrays([*taken.columns, *columns], names=[*batch.schema.names, "shelf", "cells", "bound_after"])

    return plan


_ANCHORS = "anchor_id long, label long, vector array<double>, visited int, lows array<long>, highs array<long>"
_FOUND = "anchor_id long, low long, high long, vec_id long, score long"


def _scored(width: int, best: int, same_label: bool):
    """The best rows of a shelf for each anchor that asks, from rows sorted by shelf, its vectors before its anchors."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, rows = None, [], None
        for batch in batches:
            shelf, part = np.asarray(batch.column("shelf")), np.asarray(batch.column("part"))
            cuts = np.flatnonzero(np.concatenate(([True], (np.diff(shelf) != 0) | (np.diff(part) != 0), [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if (shelf[a], part[a]) != current:
                    current, held, rows = (shelf[a], part[a]), [], None
                group = batch.slice(a, b - a)
                filed = group.filter(group.column("cell").is_valid())
                if filed.num_rows:
                    held.append((np.asarray(filed.column("vec_id")), np.asarray(filed.column("label")), np.asarray(filed.column("cell")).astype(np.int64), _matrix(filed.column("vector"), width)))
                asking = group.filter(group.column("cell").is_null())
                if asking.num_rows and held:
                    if rows is None:
                        rows = [np.concatenate(c) for c in zip(*held)]
                        order = np.argsort(rows[0], kind="stable")
                        rows = [c[order] for c in rows]
                    for low in range(0, asking.num_rows, _SLICE):
                        yield _answers(asking.slice(low, _SLICE), rows, width, best, same_label)

    return score


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every sum stays below 2^53."""
    if len(x) and len(y) and np.abs(x).max() * np.abs(y).max() * x.shape[1] >= 2.0**53:
        return x.astype(np.int64) @ y.astype(np.int64).T
    return (x @ y.T).astype(np.int64)


def _answers(asking: pa.RecordBatch, rows: list[np.ndarray], width: int, best: int, same_label: bool) -> pa.RecordBatch:
    ids, labels, cells, vectors = rows
    scores = _products(_matrix(asking.column("vector"), width), vectors)
    anchors, own = asking.column("anchor_id").to_pylist(), asking.column("label").to_pylist()
    lows, highs = asking.column("lows").to_pylist(), asking.column("highs").to_pylist()
    found = []
    for i, (anchor, wanted) in enumerate(zip(anchors, asking.column("cells").to_pylist())):
        fits = np.isin(cells, wanted) & (ids != anchor) & ((labels == own[i]) == same_label)
        for low, high in zip(lows[i] or [None], highs[i] or [None]):
            some = np.flatnonzero(fits if low is None else fits & (scores[i] >= low) & (scores[i] <= high))
            if len(some) > best:
                least = np.partition(scores[i][some], -best)[-best]
                some = some[scores[i][some] >= least]
            some = some[np.argsort(-scores[i][some], kind="stable")][:best]
            found += [(anchor, low, high, int(ids[k]), int(scores[i][k])) for k in some]
    columns = list(zip(*found)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "low", "high", "vec_id", "score"])


def _visit(index: DataFrame, books, todo: DataFrame, window: int, width: int, best: int, same_label: bool, anchors_a_task: int) -> tuple[DataFrame, DataFrame]:
    """One window: what was found (``_FOUND``) and the bound that is left for each anchor."""
    asked = kept(todo.mapInArrow(_planned(books, window, width), f"{_ANCHORS}, shelf long, cells array<int>, bound_after double"), "asked")
    # An anchor asks a shelf once, so parts follow from the number of anchors alone.
    parts = max(1, -(-todo.count() // anchors_a_task))
    asking = asked.where("shelf >= 0").withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)))
    shelves = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = shelves.unionByName(asking, allowMissingColumns=True).repartition("shelf", "part")
    found = met.sortWithinPartitions("shelf", "part", F.col("cell").asc_nulls_last()).mapInArrow(_scored(width, best, same_label), _FOUND)
    bounds = asked.groupBy("anchor_id").agg(F.max("bound_after").alias("bound_after"))
    return found, bounds


def _best(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "low", "high").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _same_window(x: str, y: str) -> Column:
    """The same anchor and window of scores; an anchor without windows has nulls."""
    same = F.col(f"{x}.anchor_id") == F.col(f"{y}.anchor_id")
    for end in ("low", "high"):
        same = same & F.col(f"{x}.{end}").eqNullSafe(F.col(f"{y}.{end}"))
    return same


def _search(index: DataFrame, books, anchors: DataFrame, width: int, best: int, same_label: bool, anchors_a_task: int) -> DataFrame:
    """The ``best`` rows for each anchor, or for each of its windows of scores, with their ``rank``."""
    cells = len(books.value.shelves)
    window, todo, done = max(8, cells // 8), kept(anchors, "anchors"), []
    pending = None
    while todo.head(1):
        found, bounds = _visit(index, books, todo, window, width, best, same_label, anchors_a_task)
        if pending is not None:
            found = found.unionAll(pending)
        found = kept(_best(found, best), "found")
        # A window of scores is certified if the next bound is below its low end or below the last of its best rows.
        ends = found.groupBy("anchor_id", "low", "high").agg(F.count("*").alias("n"), F.min("score").alias("last"))
        open_ = todo.select("anchor_id", F.explode_outer(F.arrays_zip("lows", "highs")).alias("z")).select("anchor_id", F.col("z.lows").alias("low"), F.col("z.highs").alias("high"))
        state = open_.alias("o").join(ends.alias("e"), _same_window("o", "e"), "left").select("o.*", "n", "last").join(bounds, "anchor_id")
        left = (F.col("bound_after") > float("-inf")) & (F.col("low").isNull() | (F.col("bound_after") >= F.col("low")))
        left = left & ~F.coalesce((F.col("n") >= best) & (F.col("last") > F.col("bound_after")), F.lit(False))
        state = kept(state.select("anchor_id", "low", "high", left.alias("left")), "state")
        still = state.where("left").groupBy("anchor_id").agg(
            F.array_sort(F.collect_list(F.struct("low", "high"))).alias("z")
        ).select("anchor_id", F.col("z.low").alias("lows"), F.col("z.high").alias("highs"))
        none = F.array().cast("array<long>")
        no_window = F.col("highs")[0].isNull()
        todo = kept(
            todo.drop("lows", "highs").join(still, "anchor_id").select(
                "anchor_id", "label", "vector", (F.col("visited") + window).cast("int").alias("visited"),
                F.when(no_window, none).otherwise(F.col("lows")).alias("lows"), F.when(no_window, none).otherwise(F.col("highs")).alias("highs"),
            ),
            "anchors",
        )
        met = _same_window("f", "s")
        settled = found.alias("f").join(state.where("NOT left").alias("s"), met, "left_semi")
        pending = found.alias("f").join(state.where("left").alias("s"), met, "left_semi").drop("rank")
        done.append(settled)
        window *= 2
    if not done:
        return index.sparkSession.createDataFrame([], f"{_FOUND}, rank int")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionAll(more)
    return whole


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    codewords: int | None = None,
    shelf_rows: int | None = None,
    anchors_a_task: int = 1 << 16,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id``, ``label`` and ``vector``, an array of whole numbers; a score is the inner product with
    the anchor, greater ones first, ties by the smaller id. The positives of an anchor are its first
    ``positives`` other rows of the same label, and for each of them the first ``negatives`` rows of other labels
    follow whose score is between ``window`` percent of the positive's. A positive without such rows, as every one with a
    negative score, gives no row. What ``usable`` leaves out takes no part; equal vectors are ordered by id.
    Products are exact while components stay below about 2^31 over the root of their number. Other columns are not
    read. No rows in, no rows out.
    """
    marked, width = usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"), is_anchor.alias("is_anchor")))
    index, books = build_index(marked, width, codewords, shelf_rows)
    books = rows.sparkSession.sparkContext.broadcast(books)
    none = F.array().cast("array<long>")
    anchors = marked.where("is_anchor").select(F.col("vec_id").alias("anchor_id"), "label", "vector", F.lit(0).alias("visited"), none.alias("lows"), none.alias("highs"))
    anchors = kept(anchors, "anchors")
    own = _search(index, books, anchors, width, positives, True, anchors_a_task)
    own = kept(own.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low = F.expr(f"(positive_score * {window[0]} + 99) div 100")
    high = F.expr(f"(positive_score * {window[1]}) div 100")
    windows = own.where("positive_score >= 0").select("anchor_id", low.alias("low"), high.alias("high")).where("low <= high").distinct()
    targets = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("z"))
    second = anchors.drop("lows", "highs").join(targets, "anchor_id").select(
        "anchor_id", "label", "vector", "visited", F.col("z.low").alias("lows"), F.col("z.high").alias("highs")
    )
    other = _search(index, books, second, width, negatives, False, anchors_a_task)
    return own.where("positive_score >= 0").withColumn("low", low).withColumn("high", high).join(
        other.select("anchor_id", "low", "high", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "low", "high"]
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

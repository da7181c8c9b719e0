"""Documents with nearly the same n-grams, by blocked sparse products.

A document is the set of its distinct word n-grams. Two documents link when their sets overlap in at
least ``percent`` of the union. The overlaps come from products of sparse document by n-gram matrices,
block by block; three bounds derived from sizes keep the blocks few:

* Linked sets of sizes a and b differ in at most (a + b)(1 - t)/(1 + t) n-grams. So if the space of
  n-grams is split into one part more than that, linked sets agree exactly on some part. Each document
  is filed under its parts (their number is fixed by a size class; a document that may link into the
  class below is filed there as well). Documents that share a part become candidates, as chains, never
  as pairs. A part holds several n-grams, so common n-grams do not bring strangers together.
* Below 85 percent those parts would hold too little. There a document is filed under its rarest n-grams:
  linked sets overlap in at least t of the larger one, so in any fixed order of all n-grams the first
  n - ceil(t n) + 1 of both have one in common. The order puts those n-grams last that batches of
  documents have seen most often (a list of bounded size; any list gives whole results), so a passage that
  many documents share brings nobody together.
* Only documents of one connected group of candidates are multiplied with each other. Groups lie one
  after the other, in order of size, in blocks of bounded content; a group that fills many blocks has
  products of those pairs of blocks whose sizes allow a link. Where only components are asked for, each block is
  multiplied with itself first, then with its neighbour, and then only those documents of two blocks that still hold a
  candidate pair between different components, so a cluster of thousands of near copies is no square.
* In a product, pairs whose overlap is below the bound of their sizes are discarded at once; what
  leaves is, for each document, its number of links and one link of a spanning forest.

Documents with equal sets are one row of the matrix with a weight. Sharing a part is settled inside a
batch first, so a part that a third of all documents share leaves a batch once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logharbor.llm.common import (
    LOWER,
    IdMap,
    buffers,
    give_back,
    kept,
    lean,
    mixed_bits,
    one_row_each,
    one_text_each,
    smallest_reachable,
    stretches,
    with_running_total,
    without_ids,
    word_bounds,
    word_numbers,
)
from logharbor.operators.density import connected_components

_CLASS_STEPS = 3
#: The least percentage for which a part holds enough to be telling.
_PARTS_FROM = 85
#: Bins of a sketch, and members of a bucket whose pairs are all looked at.
_BINS, _FEW = 64, 32
#: Owners of an n-gram up to which it adds to their pairs one by one.
_FEW_OWNERS = 4
#: Sets and texts up to which a second number comes from other numbers of the words.
_SMALL_SET, _SMALL_TEXT = 64, 1 << 16
_U = np.uint64


def ngram_sets(data: np.ndarray, at: np.ndarray, words: int, seed: int = 0) -> list[np.ndarray]:
    """For each text the sorted distinct numbers of its n-grams; with fewer words, of the whole sequence."""
    starts, ends, counts = word_bounds(data, at)
    number = word_numbers(data, starts, ends, seed)
    grams = np.zeros(max(len(number) - words + 1, 0), _U)
    for i in range(words):
        grams = mixed_bits(grams * _U(0x9E3779B97F4A7C15) + number[i : i + len(grams)])
    found, low = [], 0
    for count in counts.tolist():
        if count >= words:
            found.append(np.unique(grams[low : low + count - words + 1]))
        elif count:
            whole = np.zeros(1, _U)
            for i in range(count):
                whole = mixed_bits(whole * _U(0x9E3779B97F4A7C15) + number[low + i])
            found.append(mixed_bits(whole + _U(count)))
        else:
            found.append(np.zeros(0, _U))
        low += count
    return found


def _second_sums(data: np.ndarray, at: np.ndarray, words: int, sets: list[np.ndarray]) -> list[int]:
    """A second number for each set, which decides with the first one whether sets are equal.

    Sets of few n-grams get it from other numbers of the same words, so equal sets agree in 128 bits; larger
    sets would need many equal n-gram numbers at once.
    """
    second = [int((mixed_bits(s ^ _U(0x5851F42D4C957F2D))).sum(dtype=_U)) for s in sets]
    small = [i for i, s in enumerate(sets) if 0 < len(s) <= _SMALL_SET and at[i + 1] - at[i] <= _SMALL_TEXT]
    if small:
        part = np.concatenate([data[at[i] : at[i + 1]] for i in small])
        ends = np.concatenate(([0], np.cumsum([at[i + 1] - at[i] for i in small]))).astype(np.int64)
        for i, other in zip(small, ngram_sets(part, ends, words, seed=1)):
            second[i] = int(mixed_bits(other ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))
    return second


def _classes(percent: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The ratio of linked sizes; lower ends of size classes; differences that links of a class may have."""
    ratio = percent / 100
    step = ratio**-_CLASS_STEPS
    low = np.unique(np.ceil(step ** np.arange(0, int(np.log(1e10) / np.log(step)))).astype(np.int64))
    high = np.append(low[1:], low[-1] * 2)
    most = np.floor((high + high / ratio) * (1 - ratio) / (1 + ratio) + 1e-9).astype(np.int64)
    return ratio, low, most


def part_keys(grams: np.ndarray, percent: int, classes=None) -> np.ndarray:
    """The parts a set is filed under, each as one number."""
    ratio, low, most = classes or _classes(percent)
    size = len(grams)
    if not size:
        return np.zeros(0, _U)
    total = np.concatenate((np.zeros(1, _U), np.cumsum(mixed_bits(grams + _U(1)), dtype=_U)))
    own = int(np.searchsorted(low, size, side="right")) - 1
    keys = []
    for number in (own, own - 1):
        if number < 0 or (number < own and size * ratio >= low[own]):
            continue
        parts = int(most[number]) + 1
        # Even stretches of the 64-bit space; sets are sorted, so a part is a stretch of the set.
        edges = (np.arange(1, parts) * (2.0**64 / parts)).astype(_U) if parts > 1 else np.zeros(0, _U)
        cuts = np.concatenate(([0], np.searchsorted(grams, edges), [size]))
        filled = cuts[1:] > cuts[:-1]
        content = total[cuts[1:]] - total[cuts[:-1]]
        key = mixed_bits(content + mixed_bits(np.arange(parts, dtype=_U) + (_U(number) << _U(40))))
        # Parts empty on both sides agree, too; they count only if there are enough to stand for all agreement.
        keys.append(key if (~filled).sum() >= parts - most[number] else key[filled])
    return np.concatenate(keys)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _repeated(words: int):
    """N-grams that several documents of a batch hold, with how many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 5000):
            data, at = buffers(batch.column("text"))
            # One array for each stretch of texts, not one for each text, is kept until the slice is counted.
            runs = [np.concatenate(ngram_sets(LOWER[data[at[a] : at[b]]], at[a : b + 1] - at[a], words)) for a, b in stretches(at)]
            every = np.concatenate([np.zeros(0, _U), *runs])
            del runs
            every.sort()
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(every)))
            some = times > 1
            yield pa.RecordBatch.from_arrays([pa.array(every[first][some].view(np.int64)), pa.array(times[some])], names=["gram", "times"])

    return count


def common_numbers(rows: DataFrame, words: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` n-grams seen most often inside batches, sorted, and how often."""
    seen = rows.mapInArrow(lean(_repeated(words)), "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    top = kept(seen.orderBy(F.desc("times"), "gram").limit(most), "common").toArrow()
    grams, times = top.column("gram").to_numpy().view(_U), top.column("times").to_numpy()
    order = np.argsort(grams)
    found = grams[order], times[order]
    del top, grams, times
    give_back()
    return found


def rare_keys(grams: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n-grams of a set in the common order, as many as links of this size need."""
    size = len(grams)
    if not size:
        return grams
    known, often = common
    times = np.zeros(size, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        times = np.where(known[at] == grams, often[at], 0)
    need = -(-percent * size // 100)
    return grams[np.lexsort((grams, times))[: size - need + 1]]


def _filed(words: int, percent: int, common=None):
    classes = _classes(percent)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rare n-grams need nothing of the other rows of a batch, so little is held at a time.
        for batch in batches if common is None else _slices(batches, 512):
            data, at = buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            sizes, first, second, keys, sketches = [], [], [], [], []
            for a, b in stretches(at):
                part, ends = LOWER[data[at[a] : at[b]]], at[a : b + 1] - at[a]
                sets = ngram_sets(part, ends, words)
                second += _second_sums(part, ends, words, sets)
                for grams in sets:
                    sizes.append(len(grams))
                    first.append(mixed_bits(grams + _U(7)).sum(dtype=_U))
                    if common is None:
                        keys.append(part_keys(grams, percent, classes))
                    else:
                        keys.append(rare_keys(grams, percent, common.value))
                        bins = np.bincount((grams >> _U(58)).astype(np.int64), minlength=_BINS)
                        sketches.append(np.minimum(bins, 255).astype(np.uint8).tobytes())
            counts = np.array([len(k) for k in keys], np.int64)
            every = np.concatenate(keys) if keys else np.zeros(0, _U)
            owner = np.repeat(np.arange(len(keys)), counts)
            # In a batch only the first document of a part carries its key; the others name that document.
            if common is None:
                _, where, back = np.unique(every, return_index=True, return_inverse=True)
                leader = owner[where][back]
                leads = np.zeros(len(every), bool)
                leads[where] = True
            else:  # all pairs of small buckets are looked at, so every document carries its keys
                leads, leader = np.ones(len(every), bool), owner
            follows = np.unique(np.stack([owner, leader], axis=1)[leader != owner], axis=0).reshape(-1, 2)
            lead_ends = np.concatenate(([0], np.cumsum(np.bincount(owner[leads], minlength=len(keys))))).astype(np.int32)
            near_ends = np.concatenate(([0], np.cumsum(np.bincount(follows[:, 0], minlength=len(keys))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.array(sizes, np.int64)),
                    pa.array(np.array(first, _U).view(np.int64)),
                    pa.array(np.array(second, _U).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(lead_ends), pa.array(every[leads].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(near_ends), pa.array(ids[follows[:, 1]].astype(np.int64))),
                    pa.array(sketches or [None] * batch.num_rows, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "sum_a", "sum_b", "keys", "near", "sketch"],
            )

    return file


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: each row that has the key of the row before it is linked to that row."""
    last_key, last_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key = np.concatenate((last_key, np.asarray(batch.column("key"))))
        doc = np.concatenate((last_doc, np.asarray(batch.column("doc_id"))))
        same = key[1:] == key[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(doc[:-1][same]), pa.array(doc[1:][same])], names=["a", "b"])
        last_key, last_doc = key[-1:], doc[-1:]


def _bucket_pairs(percent: int):
    """Rows sorted by key, size and document: all pairs of a small bucket whose sizes allow a link, to be looked
    at; of a larger bucket the chain of neighbours whose sizes allow one, which connects no less, with its ``key``."""

    def emit(key, size, doc, big, last):
        """Pairs of whole buckets; the last one may still go on and is handed back unless ``last``."""
        n = len(key)
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [n]))
        width = np.diff(cuts)
        wide = width > _FEW
        if big:
            wide[0] = True
        end = n
        if not last and not wide[-1]:
            end = int(cuts[-2])
        large = np.repeat(wide, width)[:end]
        found = []
        for step in range(1, min(_FEW, end)):
            near = (key[step:end] == key[: end - step]) & (percent * size[step:end] <= 100 * size[: end - step])
            near &= ~large[step:] if step > 1 else True
            at = np.flatnonzero(near)
            found.append((doc[at], doc[at + step], large[at], key[at]))
        rest = slice(end, n) if end < n else slice(n - 1, n)
        return found, (key[rest], size[rest], doc[rest], bool(wide[-1]) and end == n)

    def out(found):
        if found:
            a, b, large, key = (np.concatenate(c) for c in zip(*found))
            few = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[~large], axis=0)
            known = np.concatenate((np.zeros(len(few), bool), np.ones(int(large.sum()), bool)))
            keys = np.concatenate((np.zeros(len(few), np.int64), key[large]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((few[:, 0], a[large]))),
                    pa.array(np.concatenate((few[:, 1], b[large]))),
                    pa.array(keys, mask=~known),
                ],
                names=["a", "b", "key"],
            )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = (none, none, none, False)
        for batch in batches:
            if batch.num_rows:
                columns = [np.concatenate((old, np.asarray(batch.column(c)))) for old, c in zip(held, ("key", "n", "doc_id"))]
                # A large bucket that ended with the batch before left its last row, which begins nothing new.
                if held[3] and columns[0][0] != columns[0][1]:
                    columns, held = [c[1:] for c in columns], (none, none, none, False)
                found, held = emit(*columns, held[3], False)
                yield from out(found)
        if len(held[0]) > 1:
            yield from out(emit(*held[:3], held[3], True)[0])

    return pairs


def _alike(percent: int):
    """Pairs whose sketches do not rule a link out: counts in bins differ by no more than the sets do."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (buffers(batch.column(c))[0].reshape(-1, _BINS).astype(np.int16) for c in ("sketch_a", "sketch_b"))
            total = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
            close = np.abs(x - y).sum(axis=1) * (100 + percent) <= total * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(close)), batch.column("b").filter(pa.array(close))], names=["a", "b"])

    return choose


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None, columns: int = 2048) -> np.ndarray:
    """Overlap counts of sets: the product of their sparse incidence matrices.

    Entries are sorted by n-gram; n-grams with the same owners are one column with a multiplicity. A column of few
    owners adds to their pairs directly, the others are multiplied in blocks of columns, in doubles, which
    count exactly up to 2^53.
    """
    sets = left if right is None else left + right
    n, shape = len(sets), (len(left), len(sets) if right is None else len(right))
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")  # owners ascend inside an n-gram
    every, owner = every[order], owner[order]
    begins = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    count = np.diff(np.append(begins, len(every)))
    begins, count = begins[count > 1], count[count > 1]
    result = np.zeros(shape, np.int64)
    if not len(begins):
        return result
    marks = mixed_bits(owner.astype(_U) + _U(1))
    bounds = _bounds(begins, count, len(every))
    first, second = (np.add.reduceat(m, bounds)[::2] for m in (marks, mixed_bits(marks ^ _U(0x5851F42D4C957F2D))))
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]))))
    chosen, times = order[new], np.diff(np.append(new, len(order)))
    begins, count = begins[chosen], count[chosen]
    few = count <= _FEW_OWNERS
    places, amounts = [], []
    for size in np.unique(count[few]).tolist():
        some = few & (count == size)
        owners = owner[begins[some][:, None] + np.arange(size)]
        for i in range(size):
            for j in range(size):
                x, y = owners[:, i], owners[:, j] - (0 if right is None else len(left))
                inside = (x < shape[0]) & (y >= 0)
                places.append(x[inside] * shape[1] + y[inside])
                amounts.append(times[some][inside])
    if places:
        np.add.at(result.reshape(-1), np.concatenate(places), np.concatenate(amounts))
    many = np.flatnonzero(~few)
    for low in range(0, len(many), columns):
        some = many[low : low + columns]
        column = np.repeat(np.arange(len(some)), count[some])
        inner = np.arange(int(count[some].sum())) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
        block = np.zeros((n, len(some)))
        block[owner[np.repeat(begins[some], count[some]) + inner], column] = 1
        weighted = block * times[some]
        result += (weighted @ block.T if right is None else weighted[: len(left)] @ block[len(left) :].T).astype(np.int64)
    return result


def _bounds(begins: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Bounds of stretches for ``reduceat``, every second one between stretches; the last end may be the end of all."""
    bounds = np.stack([begins, begins + count], axis=1).ravel()
    return bounds[:-1] if bounds[-1] == size else bounds


def _products(words: int, percent: int):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_tile(batches):
            first, second = block.column("tile_a")[0].as_py(), block.column("tile_b")[0].as_py()
            data, at = buffers(block.column("text").combine_chunks())
            sets: list[np.ndarray] = []
            for a, b in stretches(at):
                sets += ngram_sets(LOWER[data[at[a] : at[b]]], at[a : b + 1] - at[a], words)
            names, weights, group, home = (block.column(c).to_numpy() for c in ("doc_id", "weight", "group", "block"))
            sizes = np.array([len(s) for s in sets], np.int64)
            links, forest = np.zeros(len(sets), np.int64), []
            order = np.argsort(group, kind="stable")
            for members in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                rows = members[home[members] == first]
                cols = rows if first == second else members[home[members] == second]
                if not len(rows) or not len(cols) or (first == second and len(rows) < 2):
                    continue
                shared = _overlaps([sets[i] for i in rows], None if first == second else [sets[i] for i in cols])
                close = 100 * shared >= percent * (sizes[rows][:, None] + sizes[cols][None, :] - shared)
                if first == second:
                    np.fill_diagonal(close, False)
                else:
                    links[cols] += (close * weights[rows][:, None]).sum(axis=0)
                links[rows] += (close * weights[cols][None, :]).sum(axis=1)
                x, y = np.nonzero(close)
                forest.append((rows[x], cols[y]))
            label = smallest_reachable(names.astype(np.int64), forest)
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[some].astype(np.int64)), pa.array(links[some]), pa.array(label[some])], names=["doc_id", "links", "root"]
            )

    return multiply


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one pair of blocks at a time, from rows sorted by that pair."""
    waiting: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = list(zip(batch.column("tile_a").to_pylist(), batch.column("tile_b").to_pylist()))
        low = 0
        for i, key in enumerate([*keys, None]):
            if key != current or i == len(keys):
                if i > low:
                    waiting.append(batch.slice(low, i - low))
                    low = i
                if i < len(keys):
                    if waiting:
                        yield pa.Table.from_batches(waiting)
                    waiting, current = [], key
    if waiting:
        yield pa.Table.from_batches(waiting)


def _in_blocks(wanted: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Products of the documents named in ``wanted`` (first, weight, group, block, tile_a, tile_b), stored."""
    # Only texts that have something to be multiplied with move, by the same plan at every size.
    some = IdMap(wanted.select(F.col("first").alias("doc_id"))).split(rows, True)
    texts_of = some.join(wanted.hint("merge"), F.col("doc_id") == F.col("first")).drop("first")
    return kept(
        texts_of.repartition("tile_a", "tile_b")
        .sortWithinPartitions("tile_a", "tile_b", "doc_id")
        .mapInArrow(lean(_products(words, percent)), "doc_id long, links long, root long"),
        "links",
    )


def _labels(found: DataFrame) -> DataFrame:
    """``node, label`` of all documents linked so far."""
    links = found.where("doc_id <> root").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    nodes = kept(links.select(F.col("a").alias("node")).unionAll(links.select("b")).distinct(), "nodes")
    return kept(connected_components(nodes, links), "labels")


def _all_tiles(placed: DataFrame, percent: int) -> DataFrame:
    """Every block with itself and all pairs of blocks of a group whose sizes allow a link, with their documents."""
    spread = placed.groupBy("group", "block").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    across = (
        spread.alias("x")
        .join(spread.alias("y"), (F.col("x.group") == F.col("y.group")) & (F.col("x.block") < F.col("y.block")))
        .where(100 * F.col("x.most") >= percent * F.col("y.least"))
        .select(F.col("x.block").alias("tile_a"), F.col("y.block").alias("tile_b"))
        .distinct()
    )
    tiles = kept(placed.select(F.col("block").alias("tile_a"), F.col("block").alias("tile_b")).distinct().unionAll(across), "tiles")
    either = tiles.select("tile_a", "tile_b", F.explode(F.array_distinct(F.array("tile_a", "tile_b"))).alias("block"))
    return kept(placed.join(either, "block").select("first", "weight", "group", "block", "tile_a", "tile_b"), "needed")


def _open_tiles(placed: DataFrame, labels: DataFrame, pairs: DataFrame, members: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs of blocks with the documents in them that may still link two components.

    ``pairs`` are pairs of documents to be looked at, ``members`` the documents (doc_id) of each large bucket (key). With
    ``nearest`` a bucket joins each of its blocks with its next one only, which is enough to connect a cluster.
    """
    now = placed.join(labels, F.col("first") == F.col("node"), "left").select(
        "first", "weight", "group", "block", F.col("n_shingles").alias("n"), F.coalesce("label", "first").alias("component")
    )
    now = kept(now, "now")
    side = lambda s: now.select(F.col("first").alias(s), F.col("block").alias(f"block_{s}"), F.col("component").alias(f"component_{s}"))
    apart = pairs.join(side("a"), "a").join(side("b"), "b").where("component_a <> component_b AND block_a <> block_b")
    tile_a, tile_b = F.least("block_a", "block_b").alias("tile_a"), F.greatest("block_a", "block_b").alias("tile_b")
    named = apart.select(F.explode(F.array("a", "b")).alias("first"), tile_a, tile_b)
    held = kept(members.join(now, F.col("doc_id") == F.col("first")).select("key", "first", "block", "component", "n"), "held")
    blocks = held.groupBy("key", "block").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    if nearest:
        order = Window.partitionBy("key").orderBy("block")  # one row for each block
        after = lambda c: F.lead(c).over(order).alias(f"{c}_y")
        met = blocks.select("*", *map(after, ("block", "low", "high", "least"))).where("block_y IS NOT NULL")
    else:
        met = blocks.join(
            blocks.select("key", *(F.col(c).alias(f"{c}_y") for c in ("block", "low", "high", "least"))), "key"
        ).where("block < block_y")
    met = met.where(~((F.col("low") == F.col("high")) & (F.col("low_y") == F.col("high_y")) & (F.col("low") == F.col("low_y"))))
    met = met.where(100 * F.col("most") >= percent * F.col("least_y")).select("key", F.explode(F.array("block", "block_y")).alias("block"), F.col("block").alias("tile_a"), F.col("block_y").alias("tile_b"))
    more = met.join(held, ["key", "block"]).select("first", "tile_a", "tile_b")
    tiles = named.unionAll(more).distinct()
    return kept(tiles.join(now, "first").select("first", "weight", "group", "block", "tile_a", "tile_b"), "needed")


def linked_documents(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    block_grams: int = 1 << 20,
    most_common: int = 1_000_000,
    count_links: bool = True,
) -> DataFrame:
    """``doc_id, n_shingles, n_links, component_id`` for every document.

    Words are runs of bytes other than white space, after lower-casing A-Z. Documents link when
    100 * overlap >= percent * union of their sets of distinct ``words``-word sequences; a text with fewer words
    has its whole sequence as its one n-gram, and a null or empty text or one without words has none and
    links with nothing. ``component_id`` is the smallest id reachable by links. Rows without an id are
    left out; of rows that repeat an id the greatest text counts. N-grams are compared by 64-bit numbers, sets of
    few n-grams by 128 bits. Without ``count_links`` only components are sure: pairs of documents that are connected
    already are not multiplied, and ``n_links`` counts those that were. Other columns are not read. No rows in, no
    rows out.
    """
    rows = one_text_each(docs)
    common = rows.sparkSession.sparkContext.broadcast(common_numbers(rows, words, most_common)) if percent < _PARTS_FROM else None
    filed = kept(
        rows.mapInArrow(lean(_filed(words, percent, common)), "doc_id long, n_shingles long, sum_a long, sum_b long, keys array<long>, near array<long>, sketch binary"),
        "filed",
    )
    if common is None:
        keyed = filed.select("doc_id", F.explode("keys").alias("key"))
        chains = keyed.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(lean(_chains), "a long, b long")
    else:
        keyed = filed.select("doc_id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
        met = keyed.repartition("key").sortWithinPartitions("key", "n", "doc_id").mapInArrow(lean(_bucket_pairs(percent)), "a long, b long, key long")
        met = kept(met, "met")
        side = lambda s: filed.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
        looked = met.where("key IS NULL").select("a", "b").distinct().join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
        looked = kept(looked.mapInArrow(lean(_alike(percent)), "a long, b long"), "looked")
        crowded = met.where("key IS NOT NULL")
        chains = crowded.select("a", "b").unionAll(looked)
        in_crowds = crowded.select("key", F.col("a").alias("doc_id")).unionAll(crowded.select("key", "b")).distinct()
    near = filed.select(F.col("doc_id").alias("a"), F.explode("near").alias("b"))
    edges = kept(near.unionAll(chains).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    ends = kept(edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct(), "ends")
    groups = connected_components(ends, edges)
    members = kept(
        filed.drop("keys", "near", "sketch").join(groups, F.col("doc_id") == F.col("node")).select(
            "doc_id", "n_shingles", "sum_a", "sum_b", F.col("label").alias("group")
        ),
        "members",
    )
    # Documents with equal sets are one; the smallest id stands for them.
    equal = kept(members.groupBy("n_shingles", "sum_a", "sum_b").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight"), F.min("group").alias("group")), "equal")
    several = equal.groupBy("group").count().where("count > 1").select(F.col("group").alias("wide"))
    placed = with_running_total(
        equal.join(several, F.col("group") == F.col("wide"), "left_semi").withColumn("load", F.greatest("n_shingles", F.lit(block_grams // 1024))),
        ["group", "n_shingles", "first"],
        "load",
        "placed",
    ).select("first", "weight", "group", "n_shingles", F.floor(F.col("before") / block_grams).alias("block"))
    if count_links or common is None:
        found = _in_blocks(_all_tiles(placed, percent), rows, words, percent)
    else:
        # Each block with itself, then neighbouring blocks, then what is left between components.
        placed = kept(placed, "in_blocks")
        found = _in_blocks(placed.select("first", "weight", "group", "block", F.col("block").alias("tile_a"), F.col("block").alias("tile_b")), rows, words, percent)
        for nearest in (True, False):
            open_ = _open_tiles(placed, _labels(found), looked, in_crowds, percent, nearest)
            if open_.head(1):
                found = found.unionAll(_in_blocks(open_, rows, words, percent))
    labels = _labels(found)
    sums = found.groupBy("doc_id").agg(F.sum("links").alias("links"))
    classes = kept(
        equal.join(sums, F.col("first") == F.col("doc_id"), "left")
        .join(labels, F.col("first") == F.col("node"), "left")
        .select(
            F.col("n_shingles").alias("n"),
            F.col("sum_a").alias("a"),
            F.col("sum_b").alias("b"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("label", "first").alias("component_id"),
        )
        .where("n_links > 0"),
        "classes",
    )
    return filed.join(
        classes, (F.col("n_shingles") == F.col("n")) & (F.col("sum_a") == F.col("a")) & (F.col("sum_b") == F.col("b")), "left"
    ).select(
        "doc_id",
        "n_shingles",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest id of their component; of rows that repeat an
    id, one."""
    rows = one_row_each(docs)
    return without_ids(rows, linked_documents(rows, words, percent, count_links=False).where("doc_id <> component_id"))

"""Repeated byte strings across all texts, by blockwise suffix sorting over a cover sample.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Sorting all suffixes of
all texts would take many times the size of the input, so only a cover sample of them is sorted: of
every ``length`` bytes in a row at least one position is in the sample, and which one depends on those
bytes alone (the least hash of a short gram), so equal strings meet the sample at the same distance.

1. Each sampled suffix goes to the bucket of its first bytes, together with the rank of its whole
   surroundings, as far as a string of ``length`` bytes through it can reach. Members of a bucket with
   equal surroundings are settled at once: all but the first are covered throughout.
2. A bucket with different surroundings is sorted by itself. Few members: their common stretches to
   the left and right of the sample are compared. Many: all their suffixes are sorted by ranks of a
   difference cover: the ranks of blocks at multiples of a period, doubled until they span the middle of
   a string, resolve the long ties; the few bytes around them decide the rest. Very many: the distances from
   the sample are cut into four ranges, and members go on, range by range, with those that share the bytes
   which all strings of the range hold; only what is crowded at a single distance is sorted by Spark.
3. Covered stretches are joined for each text and cut out.

Equal surroundings inside a batch are one row from the start, so a passage in a third of all texts
leaves a batch once. Memory is bounded by the batch, the piece and the bucket limits. Texts move
between tasks only if they have something to compare or to cut; a bit map of bounded size tells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import IdMap, buffers, byte_numbers, kept, lean, mixed_bits, one_text_each, power_tables, stretches

_U = np.uint64
_PIECE = 1 << 20
#: Bytes of texts whose samples are held at a time, and surroundings cut out at a time.
_STRETCH, _CUTS = 4 << 20, 5000
_FEW = 48
_MANY = 4096
#: Ranges of starts that a crowded bucket is cut into.
_WAYS = 4


def _sliding(values: np.ndarray, width: int, combine) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, from running ones inside blocks of that width."""
    n = len(values)
    padded = np.concatenate((values, np.full(-n % width, values[-1])))
    blocks = padded.reshape(-1, width)
    ahead = combine.accumulate(blocks, axis=1).ravel()
    behind = combine.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return combine(behind[: n - width + 1], ahead[width - 1 : n])


def cover_sample(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Sampled positions with the number of the gram there, the number of the surroundings and their reach."""
    span = length - gram + 1
    reach = length - gram
    powers, backs = power_tables(_PIECE + 4 * length)
    found = []
    for low in range(0, max(len(data) - length + 1, 0), _PIECE):
        high = min(low + _PIECE, len(data) - length + 1)  # starts of strings
        begin, end = max(low - reach, 0), min(high + reach + length, len(data))
        total = np.zeros(end - begin + 1, _U)
        np.cumsum(byte_numbers(data[begin:end]) * powers[: end - begin], out=total[1:])

        def number(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            return mixed_bits((total[stop - begin] - total[start - begin]) * backs[start - begin])

        place = np.arange(low, high + reach)
        grams = np.maximum(number(place, place + gram), _U(1))
        least = _sliding(grams, span, np.minimum)
        # Strings that would run over the end of their text are none.
        edges = at[(at > low) & (at < high + length)]
        broken = np.zeros(high - low + 1, np.int64)
        np.add.at(broken, np.maximum(edges - length + 1, low) - low, 1)
        np.add.at(broken, np.minimum(edges, high) - low, -1)
        least[np.cumsum(broken)[:-1] > 0] = 0
        # A position is sampled if it is the least of some string that holds its gram.
        none = np.zeros(reach, _U)
        best = _sliding(np.concatenate((none, least, none)), span, np.maximum)
        chosen = np.flatnonzero(best == grams)
        position = place[chosen]
        text = np.searchsorted(at, position, side="right") - 1
        left = np.minimum(position - at[text], reach)
        right = np.minimum(at[text + 1] - position, length)
        around = mixed_bits(number(position - left, position + right) + (left * 1024 + right).astype(_U) * _U(0x9E3779B97F4A7C15))
        found.append((position, text, grams[chosen], around, left, right))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, _U, _U, np.int64, np.int64))
    columns = [np.concatenate(c) for c in zip(*found)]
    _, once = np.unique(columns[0], return_index=True)  # Neighbouring pieces may choose the same.
    return tuple(c[once] for c in columns)


def _triples(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return np.stack([doc, start, stop], axis=1).ravel()


def _samples(length: int, gram: int):
    def rows(data: np.ndarray, at: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        position, text, grams, around, left, right = cover_sample(data, at, length, gram)
        doc, place = ids[text].astype(np.int64), position - at[text]
        order = np.lexsort((place, doc, around, grams))
        doc, place, grams, around, left, right = (c[order] for c in (doc, place, grams, around, left, right))
        first = np.ones(len(doc), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (around[1:] != around[:-1])
        owner = np.cumsum(first) - 1
        later = ~first
        covered = _triples(doc[later], (place - left)[later], (place + right)[later])
        ends = np.concatenate(([0], np.cumsum(3 * np.bincount(owner[later], minlength=int(first.sum()))))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(grams[first].view(np.int64)),
                pa.array(around[first].view(np.int64)),
                pa.array(doc[first]),
                pa.array(place[first]),
                pa.array((left * 65536 + right)[first].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(covered)),
            ],
            names=["bucket", "around", "doc_id", "place", "reach", "covered"],
        )

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for a, b in stretches(at, _STRETCH):
                yield rows(data[at[a] : at[b]], at[a : b + 1] - at[a], ids[a:b])

    return sample


_SAMPLED = "bucket long, around long, doc_id long, place long, reach int, covered array<long>"
_SETTLED = "bucket long, doc_id long, place long, left_ int, right_ int"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, surroundings and place. A row like the one before it is covered (bucket null);
    the first of its surroundings stays for comparison if its bucket holds other surroundings, too."""

    def rows(bucket, doc, place, left, right, mask=None):
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int64(), mask=mask), pa.array(doc), pa.array(place), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))],
            names=["bucket", "doc_id", "place", "left_", "right_"],
        )

    pending, last = None, None  # the last first-of-its-kind and whether one of its bucket came before
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, around, doc, place, reach = (np.asarray(batch.column(c)).astype(np.int64) for c in ("bucket", "around", "doc_id", "place", "reach"))
        left, right = reach >> 16, reach & 65535
        same = np.zeros(len(bucket), bool)
        same[1:] = (bucket[1:] == bucket[:-1]) & (around[1:] == around[:-1])
        same[0] = last is not None and last == (bucket[0], around[0])
        last = (bucket[-1], around[-1])
        more = np.asarray(batch.column("covered").flatten()).reshape(-1, 3)
        doc_c, start_c = np.concatenate((doc[same], more[:, 0])), np.concatenate((place[same], more[:, 1]))
        left_c = np.concatenate((left[same], np.zeros(len(more), np.int64)))
        right_c = np.concatenate((right[same], more[:, 2] - more[:, 1]))
        yield rows(np.zeros(len(doc_c), np.int64), doc_c, start_c, left_c, right_c, np.ones(len(doc_c), bool))
        firsts = np.stack([c[~same] for c in (bucket, doc, place, left, right)], axis=1)
        if pending is not None:
            firsts = np.concatenate((pending[0][None, :], firsts))
        if len(firsts):
            alike = firsts[1:, 0] == firsts[:-1, 0]
            mixed = np.zeros(len(firsts), bool)
            mixed[1:] |= alike
            mixed[:-1] |= alike
            if pending is not None:
                mixed[0] |= pending[1]
            out = firsts[:-1][mixed[:-1]]
            pending = (firsts[-1], bool(mixed[-1]))
            yield rows(*(out[:, i] for i in range(5)))
    if pending is not None and pending[1]:
        yield rows(*(pending[0][i : i + 1] for i in range(5)))


def _cut(reach: int, length: int):
    """Surroundings of wanted positions, the sample at column ``reach``, zeros beyond the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            wanted = batch.column("wanted")
            counts = np.asarray(wanted.value_lengths())
            fields = wanted.flatten()
            bucket, place, left, right = (np.asarray(fields.field(i)).astype(np.int64) for i in range(4))
            owner = np.repeat(np.arange(batch.num_rows), counts)
            doc, centre = batch.column("doc_id").to_numpy()[owner], at[owner] + place
            for low in range(0, len(doc), _CUTS):
                part = slice(low, low + _CUTS)
                column = np.arange(-reach, length)
                where = centre[part, None] + column
                real = (column >= -left[part, None]) & (column < right[part, None])
                around = np.where(real, data[np.clip(where, 0, max(len(data) - 1, 0))], 0).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[part]),
                        pa.array(doc[part]),
                        pa.array(place[part]),
                        pa.array(left[part].astype(np.int32)),
                        pa.array(right[part].astype(np.int32)),
                        pa.array([row.tobytes() for row in around], pa.binary()),
                    ],
                    names=["bucket", "doc_id", "place", "left_", "right_", "around"],
                )

    return cut


def _common(x: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many leading columns are all true, at most ``limit``."""
    stop = np.where(x.all(axis=1), x.shape[1], (~x).argmax(axis=1))
    return np.minimum(stop, limit)


def cover_ranks(around: np.ndarray, depth: int, period: int) -> np.ndarray:
    """Ranks of the blocks of ``depth`` bytes at all multiples of ``period``, by doubling; ``depth`` is
    ``period`` times a power of two."""
    rows, width = around.shape
    blocks = around[:, : width // period * period].reshape(rows, -1, period)
    flat = np.ascontiguousarray(blocks).view(f"V{period}").reshape(rows, -1)
    ranks = np.unique(flat, return_inverse=True)[1].reshape(flat.shape)
    size = period
    while size < depth:
        step = size // period
        pair = ranks[:, :-step] * (int(ranks.max()) + 1) + ranks[:, step:]
        ranks = np.unique(pair, return_inverse=True)[1].reshape(pair.shape)
        size *= 2
    return ranks


def sort_suffixes(around: np.ndarray, length: int, starts: range, period: int = 20) -> Iterator[tuple[int, np.ndarray]]:
    """For each start the classes of equal strings of ``length`` bytes there, as ranks.

    The string is a few bytes, a block of four periods at the next multiple of the period, and again a
    few bytes; the block's rank is known beforehand, so no comparison goes deeper than a period.
    """
    depth = 4 * period
    ranks = cover_ranks(around, depth, period)
    for start in starts:
        next_ = -(-start // period) * period
        few = np.concatenate((around[:, start:next_], around[:, next_ + depth : start + length]), axis=1)
        few = np.unique(np.ascontiguousarray(few).view(f"V{few.shape[1]}").ravel(), return_inverse=True)[1]
        yield start, ranks[:, next_ // period] * (int(few.max(initial=0)) + 1) + few


def _compare(reach: int, length: int):
    """Covered stretches of the members of whole buckets, from rows sorted by bucket, low, doc_id and place."""

    def pairs(around, left, right, low, high):
        """All pairs of members of the buckets from row ``low`` to ``high``."""
        size = high - low
        first = np.concatenate([np.zeros(0, np.int64), *(np.repeat(np.arange(s), np.arange(s)[::-1]) for s in size)])
        second = np.concatenate([np.zeros(0, np.int64), *(np.concatenate([np.arange(i + 1, s) for i in range(s)]) if s > 1 else np.zeros(0, np.int64) for s in size)])
        base = np.repeat(low, size * (size - 1) // 2)
        i, j = (base + first).astype(np.int64), (base + second).astype(np.int64)
        for part in range(0, len(i), 20_000):
            a, b = i[part : part + 20_000], j[part : part + 20_000]
            equal = around[a] == around[b]
            to_left = _common(equal[:, :reach][:, ::-1], np.minimum(left[a], left[b]))
            to_right = _common(equal[:, reach:], np.minimum(right[a], right[b]))
            long = to_left + to_right >= length
            yield b[long], to_left[long], to_right[long]

    def stretch(doc, place, row, to_left, to_right) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(place[row] - to_left), pa.array(place[row] + to_right)], names=["doc_id", "start", "stop"]
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            bucket, doc, place, left, right = (table.column(c).to_numpy().astype(np.int64) for c in ("bucket", "doc_id", "place", "left_", "right_"))
            data = buffers(table.column("around").combine_chunks())[0]
            around = data.reshape(-1, reach + length)
            first, final = (table.column(c).to_numpy() for c in ("low", "high"))
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(bucket) != 0) | (np.diff(first) != 0)) + 1, [len(bucket)]))
            low, high = cuts[:-1], cuts[1:]
            few = high - low <= _FEW
            for row, to_left, to_right in pairs(around, left, right, low[few], high[few]):
                yield stretch(doc, place, row, to_left, to_right)
            for a, b in zip(low[~few], high[~few]):
                for start, rank in sort_suffixes(around[a:b], length, range(first[a], final[a] + 1)):
                    whole = np.flatnonzero((start >= reach - left[a:b]) & (start + length <= reach + right[a:b]))
                    # Members stand in the order of their places, so the first of a rank is the earliest.
                    _, earliest = np.unique(rank[whole], return_index=True)
                    again = np.ones(len(whole), bool)
                    again[earliest] = False
                    row = whole[again] + a
                    yield stretch(doc, place, row, reach - start, start + length - reach)

    return compare


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows that end where a bucket ends."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = np.asarray(batch.column("bucket"))
        ends = np.flatnonzero(np.diff(bucket)) + 1
        if waiting and waiting[-1].column("bucket")[-1].as_py() != bucket[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        if len(ends):
            yield pa.Table.from_batches([*waiting, batch.slice(0, int(ends[-1]))])
            waiting = [batch.slice(int(ends[-1]))]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)


def _neighbours(length: int):
    """Rows sorted by bucket, distance, string and place: a row with the string of the row before is covered."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = list(zip(batch.column("bucket").to_pylist(), batch.column("start_").to_pylist(), batch.column("string").to_pylist()))
            again = np.array([key == before for key, before in zip(keys, [last, *keys])], bool)
            last = keys[-1] if keys else last
            doc, start = (batch.column(c).to_numpy()[again].astype(np.int64) for c in ("doc_id", "place"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(start + length)], names=["doc_id", "start", "stop"])

    return compare


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the covered stretches out of each text."""
    for batch in batches:
        data, at = buffers(batch.column("text"))
        covers = batch.column("covers")
        ends = np.concatenate(([0], np.cumsum(np.asarray(covers.fill_null([]).value_lengths()))))
        fields = covers.fill_null([]).flatten()
        starts, stops = (np.asarray(fields.field(i)).astype(np.int64) for i in range(2))
        removed, spans, digest = [], [], []
        for row in range(batch.num_rows):
            text = data[at[row] : at[row + 1]]
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, starts[ends[row] : ends[row + 1]], 1)
            np.add.at(change, stops[ends[row] : ends[row + 1]], -1)
            gone = np.cumsum(change)[:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            digest.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _parted(rows: DataFrame, reach: int, length: int) -> DataFrame:
    """Members of crowded buckets for each part of their range of starts: a string of ``length`` bytes from ``low`` to ``high``
    holds the bytes from ``high`` on that name the part's bucket. Buckets that share a name by chance are told apart by their bytes."""
    width = F.ceil((F.col("high") - F.col("low") + 1) / _WAYS).cast("int")
    parts = rows.withColumn("width", width).select("*", F.explode(F.sequence("low", "high", "width")).alias("from_"))
    parts = parts.select(
        "bucket", "doc_id", "place", "left_", "right_", "around",
        F.col("from_").alias("low"), F.least(F.col("from_") + F.col("width") - 1, F.col("high")).alias("high"),
    ).where((F.greatest(F.col("low"), reach - F.col("left_"))) <= F.least(F.col("high"), reach + F.col("right_") - length))
    core = F.substring("around", F.col("high") + 1, F.col("low") + length - F.col("high"))
    return parts.withColumn("bucket", F.xxhash64("bucket", "low", core))


def _crowded(members: DataFrame) -> DataFrame:
    sizes = members.groupBy(F.col("bucket").alias("full"), F.col("low").alias("full_low")).count()
    return kept(sizes.where(f"count > {_MANY}").select("full", "full_low"), "crowded")


def covered_stretches(docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc_id, start, stop``: stretches of bytes to remove, possibly overlapping, for unique ids and no null texts."""
    gram = max(4, length // 3)
    reach = length - gram
    sampled = docs.mapInArrow(lean(_samples(length, gram)), _SAMPLED)
    settled = kept(
        sampled.repartition("bucket").sortWithinPartitions("bucket", "around", "doc_id", "place").mapInArrow(lean(_settle), _SETTLED), "settled"
    )
    known = settled.where("bucket IS NULL").select("doc_id", (F.col("place") - F.col("left_")).alias("start"), (F.col("place") + F.col("right_")).alias("stop"))
    mixed = settled.where("bucket IS NOT NULL")
    crowded = _crowded(mixed.withColumn("low", F.lit(0)))
    wanted = mixed.groupBy(F.col("doc_id").alias("wanted_id")).agg(F.collect_list(F.struct("bucket", "place", "left_", "right_")).alias("wanted"))
    texts = IdMap(mixed).split(docs, True)
    around = kept(
        texts.join(wanted, F.col("doc_id") == F.col("wanted_id")).select("doc_id", "text", "wanted").mapInArrow(
            lean(_cut(reach, length)), "bucket long, doc_id long, place long, left_ int, right_ int, around binary"
        ),
        "around",
    )
    covers = "doc_id long, start long, stop long"
    found = known
    members = around.withColumn("low", F.lit(0)).withColumn("high", F.lit(reach))
    while True:
        full = (members["bucket"] == crowded["full"]) & (members["low"] == crowded["full_low"])
        small = (
            members.join(crowded, full, "left_anti")
            .repartition("bucket")
            .sortWithinPartitions("bucket", "low", "doc_id", "place")
            .mapInArrow(lean(_compare(reach, length)), covers)
        )
        found = found.unionAll(small)
        if crowded.isEmpty():
            return found
        large = members.join(crowded, full, "left_semi")
        by_spark = (
            large.where("low = high")
            .select(
                "bucket", F.col("low").alias("start_"), F.substring("around", F.col("low") + 1, F.lit(length)).alias("string"),
                "doc_id", (F.col("place") - reach + F.col("low")).alias("place"),
            )
            .repartition("bucket", "start_")
            .sortWithinPartitions("bucket", "start_", "string", "doc_id", "place")
            .mapInArrow(lean(_neighbours(length)), covers)
        )
        found = found.unionAll(by_spark)
        members = kept(_parted(large.where("low < high"), reach, length), "members")
        crowded = _crowded(members)


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every document.

    Texts are UTF-8 bytes, null texts empty; strings never cross texts. A byte is removed if a string of
    ``length`` bytes that covers it starts earlier, too (smaller doc_id, or same text and earlier), judged
    on the input. Texts shorter than ``length`` stay whole. Rows without an id are left out; of rows that
    repeat an id the greatest text counts. Other columns are not read. No rows in, no rows out.
    """
    rows = one_text_each(docs)
    covers = kept(covered_stretches(rows, length), "covers")
    gathered = covers.groupBy(F.col("doc_id").alias("covered_id")).agg(F.collect_list(F.struct("start", "stop")).alias("covers"))
    ids = IdMap(covers.select("doc_id"))
    touched = ids.split(rows, True).join(gathered, F.col("doc_id") == F.col("covered_id"), "left").select("doc_id", "text", "covers")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    whole = ids.split(rows, False).select("doc_id", "text", none.alias("covers"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return touched.mapInArrow(lean(_apply), result).unionAll(whole.mapInArrow(lean(_apply), result))

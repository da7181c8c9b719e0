"""Lines that many documents share, by a sharded minimal perfect hash.

1. Every line that is not blank becomes a key (white space stripped at both ends, A-Z in lower case) and a number of
   128 bits. A task counts in how many of its documents a number occurs and sends each number once for every
   ``_HELD`` of them, so a line of a third of all documents is a few rows. Spark sums them.
2. Numbers found in at least ``least`` documents are dealt to shards, and each shard gets a minimal perfect hash:
   level by level, numbers that are alone at their place set its bit, the others go on to the next level; the rank
   of a bit among all bits of the shard is the slot. Slots index an array of fingerprints and an array of counts.
   The number of shards grows with the numbers, so a shard's arrays stay small.
3. Documents probe the arrays. Up to ``broadcast_bytes`` of them are sent to all tasks and every text is read once and
   moved nowhere. Larger indexes stay where they are: documents are dealt into chunks, a chunk asks each shard once for
   its distinct numbers, and the shard answers with those that are in its arrays.

A number that is not in the index is taken for one that is with a chance of 2^-64, as slots compare 64 bits that the
place of the slot does not tell.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import buffers, kept, mixed_bits, one_text_each

_U = np.uint64
_WHITE = b" \t\n\v\f\r"
#: Numbers a task holds before it hands their counts on.
_HELD = 200_000
#: Places for each number on a level of the hash; more make fewer levels and longer bit arrays.
_ROOM = 2
_INDEX = "shard int, n_lines long, levels array<int>, words binary, prints binary, counts binary"


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys."""
    lines = text.split(b"\n")
    return lines, [line.strip(_WHITE).lower() for line in lines]


def _halves(numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(numbers, ">u8").astype(_U).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _texts(batch: pa.RecordBatch) -> Iterable[bytes]:
    data, at = buffers(batch.column("text"))
    body = memoryview(data.tobytes())
    return (bytes(body[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist()))


def _counted(least_points: int):
    """Numbers of lines with the documents of this task that hold them."""

    def rows(held: dict[bytes, int]) -> pa.RecordBatch:
        high, low = _halves(b"".join(held))
        return pa.RecordBatch.from_arrays(
            [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(list(held.values()), pa.int64())], names=["high", "low", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for text in _texts(batch):
                for number in {xxhash.xxh3_128_digest(k) for k in line_keys(text)[1] if long_enough(k, least_points)}:
                    held[number] = held.get(number, 0) + 1
                if len(held) >= _HELD:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    return count


def long_enough(key: bytes, least_points: int) -> bool:
    """Whether a key has that many code points."""
    return len(key) >= least_points and (least_points <= 1 or len(key.decode("utf-8", "replace")) >= least_points)


def _place(high: np.ndarray, low: np.ndarray, level: int, size) -> np.ndarray:
    return (mixed_bits(low + mixed_bits(high + _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) % size).astype(np.int64)


def perfect_hash(high: np.ndarray, low: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and the bits of all of them, as 64-bit words, for distinct pairs."""
    sizes, bits = [], []
    while len(high):
        size = -(-_ROOM * len(high) // 64) * 64
        place = _place(high, low, len(sizes), _U(size))
        alone = np.bincount(place, minlength=size)[place] == 1
        level = np.zeros(size, bool)
        level[place[alone]] = True
        sizes.append(size)
        bits.append(level)
        high, low = high[~alone], low[~alone]
    packed = np.packbits(np.concatenate(bits), bitorder="little") if bits else np.zeros(0, np.uint8)
    return sizes, packed.view("<u8").astype(_U)


class LineArrays:
    """Arrays of some shards, to be probed with numbers of lines."""

    def __init__(self, rows: list, shards: int) -> None:
        rows = sorted(rows, key=lambda row: row["shard"])
        self._shards = shards
        self._numbers = np.array([row["shard"] for row in rows], np.int64)
        depth = max((len(row["levels"]) for row in rows), default=0)
        self._sizes = np.zeros((len(rows), depth), _U)
        for i, row in enumerate(rows):
            self._sizes[i, : len(row["levels"])] = row["levels"]
        words = [np.frombuffer(row["words"], "<u8") for row in rows]
        self._words = np.concatenate([np.zeros(0, _U), *words])
        self._ranks = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bitwise_count(self._words), dtype=np.int64)))
        begin = np.cumsum([0, *(len(w) for w in words)])[:-1].reshape(-1, 1)
        inner = np.cumsum(self._sizes.astype(np.int64) // 64, axis=1)
        self._begins = (begin + inner - self._sizes.astype(np.int64) // 64).astype(np.int64)
        self._prints = np.concatenate([np.zeros(0, _U), *(np.frombuffer(row["prints"], "<u8") for row in rows)])
        self._counts = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(row["counts"], "<u4") for row in rows)])

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each number, -1 where no bit of its shard is met. Strangers may get a slot, too."""
        slot = np.full(len(high), -1, np.int64)
        if not len(self._numbers):
            return slot
        shard = (high % _U(self._shards)).astype(np.int64)
        row = np.minimum(np.searchsorted(self._numbers, shard), len(self._numbers) - 1)
        left = np.flatnonzero(self._numbers[row] == shard)
        for level in range(self._sizes.shape[1]):
            size = self._sizes[row[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            place = _place(high[left], low[left], level, size)
            word = self._begins[row[left], level] + (place >> 6)
            bit = _U(1) << (place & 63).astype(_U)
            met = (self._words[word] & bit) > 0
            below = np.bitwise_count(self._words[word[met]] & (bit[met] - _U(1)))
            slot[left[met]] = self._ranks[word[met]] + below
            left = left[~met]
        return slot

    def counts(self, numbers: bytes) -> np.ndarray:
        """In how many documents each number was found; 0 for those that are not in the arrays."""
        high, low = _halves(numbers)
        slot = self.slots(high, low)
        there = np.flatnonzero(slot >= 0)
        known = there[self._prints[slot[there]] == low[there]]
        found = np.zeros(len(high), np.int64)
        found[known] = self._counts[slot[known]]
        return found


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of arrays for each shard, from rows sorted by shard."""

    def row(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        high, low, n = np.concatenate(parts, axis=1)
        high, low = high.view(_U), low.view(_U)
        levels, words = perfect_hash(high, low)
        one = {"shard": shard, "levels": levels, "words": words.astype("<u8").tobytes(), "prints": b"", "counts": b""}
        slot = LineArrays([{**one, "shard": 0}], 1).slots(high, low)
        prints, counts = np.zeros(len(slot), "<u8"), np.zeros(len(slot), "<u4")
        prints[slot], counts[slot] = low, n
        one |= {"n_lines": len(slot), "prints": prints.tobytes(), "counts": counts.tobytes()}
        return pa.RecordBatch.from_pylist([one], schema=_schema)

    _schema = pa.schema(
        [("shard", pa.int32()), ("n_lines", pa.int64()), ("levels", pa.list_(pa.int32())), ("words", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary())]
    )
    current, parts = None, []
    for batch in batches:
        shard = np.asarray(batch.column("shard"))
        columns = np.stack([np.asarray(batch.column(c)) for c in ("high", "low", "n")])
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                if parts and shard[a] != current:
                    yield row(int(current), parts)
                    parts = []
                current = shard[a]
                parts.append(columns[:, a:b])
    if parts:
        yield row(int(current), parts)


def line_index(docs: DataFrame, least: int = 10, least_points: int = 1, shard_lines: int = 1 << 16) -> tuple[DataFrame, int]:
    """Arrays of the lines that at least ``least`` documents hold, a row for each shard, and the number of shards.

    Keys of fewer than ``least_points`` code points are not counted. The rows are stored; ``LineArrays`` probes them,
    also for other documents than those counted here and for thresholds above ``least``.
    """
    return _index(one_text_each(docs), least, least_points, shard_lines)


def _index(rows: DataFrame, least: int, least_points: int, shard_lines: int) -> tuple[DataFrame, int]:
    seen = rows.select("text").mapInArrow(_counted(least_points), "high long, low long, n long")
    common = kept(seen.groupBy("high", "low").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "common")
    shards = max(1, -(-common.count() // shard_lines))
    # Unsigned remainder of the upper half, as in LineArrays.
    shard = F.expr(f"CAST(pmod(pmod(high, {shards}) + CASE WHEN high < 0 THEN {(1 << 64) % shards} ELSE 0 END, {shards}) AS INT)")
    dealt = common.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard")
    return kept(dealt.mapInArrow(_built, _INDEX), "line_index"), shards


def _dropped(batch: pa.RecordBatch, counts_of, least: int, least_points: int) -> pa.RecordBatch:
    """Texts without the lines whose numbers count enough."""
    n_lines, n_dropped, left = [], [], []
    held, keys, ends = [], [], [0]
    for text in _texts(batch):
        lines, found = line_keys(text)
        held.append(lines)
        keys += [xxhash.xxh3_128_digest(k) if long_enough(k, least_points) else None for k in found]
        ends.append(len(keys))
    asked = [i for i, k in enumerate(keys) if k is not None]
    gone = np.zeros(len(keys), bool)
    gone[asked] = counts_of(b"".join(keys[i] for i in asked)) >= least
    for lines, a, b in zip(held, ends[:-1], ends[1:]):
        drop = gone[a:b]
        n_lines.append(b - a)
        n_dropped.append(int(drop.sum()))
        left.append(b"\n".join(line for line, d in zip(lines, drop.tolist()) if not d))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(left, pa.binary()).view(pa.string())],
        names=["doc_id", "n_lines", "n_dropped", "text"],
    )


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


_RESULT = "doc_id long, n_lines long, n_dropped long, text string"


def _probed_everywhere(rows: DataFrame, index: DataFrame, shards: int, least: int, least_points: int) -> DataFrame:
    arrays = rows.sparkSession.sparkContext.broadcast(LineArrays(index.collect(), shards))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield _dropped(batch, arrays.value.counts, least, least_points)

    return rows.mapInArrow(probe, _RESULT)


def _asked(shards: int, least_points: int):
    """For each chunk of documents and each shard the distinct numbers the chunk asks for."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(chunk: int, held: set[bytes]) -> pa.RecordBatch:
            numbers = np.frombuffer(b"".join(held), "V16")
            shard = (_halves(numbers.tobytes())[0] % _U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            shard, numbers = shard[order], numbers[order]
            cuts = np.concatenate((np.flatnonzero(np.diff(shard, prepend=-1)), [len(shard)]))
            packed = [numbers[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(shard[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(packed), chunk, np.int64)), pa.array(packed, pa.binary())],
                names=["shard", "chunk", "numbers"],
            )

        current, held = None, set()
        for batch in batches:
            for chunk, text in zip(batch.column("chunk").to_pylist(), _texts(batch)):
                if held and (chunk != current or len(held) >= _HELD):
                    yield rows(current, held)
                    held = set()
                current = chunk
                held |= {xxhash.xxh3_128_digest(k) for k in line_keys(text)[1] if long_enough(k, least_points)}
        if held:
            yield rows(current, held)

    return ask


def _answered(shards: int, least: int):
    """Rows sorted by shard, its arrays first: the numbers of each question that count enough."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, arrays = None, None
        for batch in batches:
            chunks, found = [], []
            for row in batch.to_pylist():
                if row["chunk"] is None:
                    current, arrays = row["shard"], LineArrays([row], shards)
                elif row["shard"] == current:
                    some = np.frombuffer(row["numbers"], "V16")[arrays.counts(row["numbers"]) >= least]
                    if len(some):
                        chunks.append(row["chunk"])
                        found.append(some.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(found, pa.binary())], names=["chunk", "numbers"])

    return answer


def _applied(least_points: int):
    """Rows sorted by chunk, its answers first: the documents without the lines named there."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, named = None, set()

        def counts(numbers: bytes) -> np.ndarray:
            return np.array([numbers[i : i + 16] in named for i in range(0, len(numbers), 16)], np.int64)

        for batch in _slices(batches):
            chunk = np.asarray(batch.column("chunk"))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if chunk[a] != current:
                    current, named = chunk[a], set()
                part = batch.slice(a, b - a)
                answers = part.filter(part.column("numbers").is_valid())
                for packed in answers.column("numbers").to_pylist():
                    named |= {packed[i : i + 16] for i in range(0, len(packed), 16)}
                asked = part.filter(part.column("numbers").is_null())
                if asked.num_rows:
                    yield _dropped(asked, counts, 1, least_points)

    return apply


def _probed_by_shard(rows: DataFrame, index: DataFrame, shards: int, least: int, least_points: int, chunk_rows: int) -> DataFrame:
    chunks = max(1, -(-rows.count() // chunk_rows))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    asked = dealt.select("chunk", "text").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_asked(shards, least_points), "shard int, chunk long, numbers binary")
    met = index.unionByName(asked, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("chunk").asc_nulls_first())
    answers = met.mapInArrow(_answered(shards, least), "chunk long, numbers binary")
    both = dealt.unionByName(answers, allowMissingColumns=True).repartition("chunk")
    return both.sortWithinPartitions("chunk", F.col("numbers").asc_nulls_last()).mapInArrow(_applied(least_points), _RESULT)


def without_common_lines(
    docs: DataFrame,
    min_docs: int = 10,
    least_points: int = 1,
    broadcast_bytes: int = 32 << 20,
    shard_lines: int = 1 << 16,
    chunk_rows: int = 4096,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` for every document: ``text`` without the lines that ``min_docs`` documents hold.

    Lines end at line feeds; a null or empty text is one empty line. The key of a line is the line without white space
    (blank, tab, line feed, vertical tab, form feed, carriage return) at both ends and with A-Z in lower case. Lines whose
    key has at least ``least_points`` code points and occurs in at least ``min_docs`` documents go, all of them;
    the others stay as they are, joined by line feeds. Blank lines stay where ``least_points`` is 1 or more. A document
    that repeats a line counts once. Rows without an id are left out; of rows that repeat an id the greatest
    text counts. Other columns are not read. No rows in, no rows out.
    """
    rows = one_text_each(docs)
    index, shards = _index(rows, min_docs, max(1, least_points), shard_lines)
    size = index.agg(F.sum(_bytes("words") + _bytes("prints") + _bytes("counts"))).head()[0] or 0
    if size <= broadcast_bytes:
        return _probed_everywhere(rows, index, shards, min_docs, max(1, least_points))
    return _probed_by_shard(rows, index, shards, min_docs, max(1, least_points), chunk_rows)


def _bytes(column: str) -> Column:
    return F.octet_length(column).cast("long")

"""Packing token pieces into sequences by patterns fitted with non-negative least squares.

1. Texts become token ids; ids beyond a sequence's length are cut into full pieces and a last one.
2. The histogram of piece lengths, at most one row for each length, goes to the driver.
3. Lengths fall into coarse classes. All ways to fill a sequence with a few classes are enumerated, and
   non-negative least squares fits how often each is repeated so that the classes are used up.
4. Rounded down, the patterns are played out on the exact lengths, the last piece of a sequence being the
   longest that fits. What is left is placed by best fit, longest first, still on the histogram: whole
   groups of equal lengths move at a time, so the driver's work depends on the sequence length only.
5. Pieces, sorted by length in ranges, look up sequence and offset by their position.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logharbor.llm.common import Remembered, buffers, kept, letters_of_bytes, stretches, texts, with_running_total

#: The splitting rule of the word vocabulary (fixed value of the tokenizer) on printable ASCII and the letters of Latin-1;
#: a blank is a piece of its own.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-z0-9ß-öø-ÿ]+| ")
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
#: Behind a word's last byte; a sign that no plain word holds.
_END = "\x01"
#: Bytes of texts whose words are looked up together.
_STRETCH = 4 << 20
_CLASSES = 64
_PARTS = 4


@lru_cache(maxsize=4)
def merge_ranks(vocabulary: str) -> frozenset[tuple[bytes, int]]:
    """Tokens by their bytes, those that end a word with ``_END`` behind them, numbered in the order of merges.

    Merging the neighbours that make the token of the lowest number is then what the library does: a token that its own
    bytes are merged to cannot be made from any other two neighbours. Tokens of which that is not so are never made and
    left out. Empty where the numbers do not follow the merges; then the library has to do it.
    """
    model, byte, last = json.loads(vocabulary)["model"], letters_of_bytes(), _END.encode()
    number, end = model["vocab"], model.get("end_of_word_suffix")
    if not end or not all(letter in number and letter + end in number for letter in byte):
        return frozenset()
    ranks = {bytes([b]): number[letter] for letter, b in byte.items()}
    ranks.update({bytes([b]) + last: number[letter + end] for letter, b in byte.items()})
    pairs = [merge.split(" ") if isinstance(merge, str) else merge for merge in model["merges"]]
    made = {(number[a], number[b]): number[a + b] for a, b in pairs}
    newest = max(ranks.values())
    for a, b in pairs:
        token, whole = number[a + b], a + b
        if token <= max(newest, number[a], number[b]):
            return frozenset()
        newest, body = token, whole.removesuffix(end)
        ids = [number[letter] for letter in body]
        if body != whole:
            ids[-1] = number[body[-1] + end]
        while len(ids) > 1:
            lowest = min(made.get(pair, token + 1) for pair in zip(ids, ids[1:]))
            if lowest > token:
                break
            joined, at = [], 0
            while at < len(ids):
                meet = made.get(tuple(ids[at : at + 2])) == lowest
                joined.append(lowest if meet else ids[at])
                at += 1 + meet
            ids = joined
        if ids == [token]:
            ranks[bytes(byte[letter] for letter in body) + last * (body != whole)] = token
    return frozenset(ranks.items())


class WordIds:
    """Token ids of texts for a vocabulary with word ends.

    Texts are taken apart at blanks and line feeds, which end a token in any case, and every different word is looked at
    once. Words of plain characters are split here and merged together, by tiktoken with the numbers of
    ``merge_ranks``; all others go through the whole library and are remembered.
    """

    def __init__(self, vocabulary: str, ranks: frozenset[tuple[bytes, int]], remembered: int = 150_000) -> None:
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_str(vocabulary)
        self._marks = [token.content for token in self._library.get_added_tokens_decoder().values()]
        self._others = Remembered(self._other, remembered)
        self._merge = None
        if ranks:
            import tiktoken

            known = dict(ranks)
            self._blank = known[b" " + _END.encode()]
            # It looks for special tokens in any case; this one is in no text.
            special = {2 * _END: max(known.values()) + 1}
            self._merge = tiktoken.Encoding(
                "ids", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=known, special_tokens=special
            ).encode_to_numpy

    def _other(self, word: str) -> np.ndarray:
        return np.array(self._library.encode(word, add_special_tokens=False).ids, np.uint32)

    def _plain(self, words: pa.Array) -> np.ndarray:
        """Marks of the words that are split and merged here."""
        if self._merge is None:
            return np.zeros(len(words), bool)
        plain = pc.match_substring_regex(words, _PLAIN)
        for mark in self._marks:
            plain = pc.and_not(plain, pc.match_substring(words, mark))
        return plain.to_numpy(zero_copy_only=False)

    def _each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, and where those of each start, with the end of the last."""
        plain = self._plain(words)
        found = [self._others[word] if word else np.zeros(0, np.uint32) for word in words.filter(pa.array(~plain)).to_pylist()]
        size = np.zeros(len(words), np.int64)
        size[~plain] = [len(ids) for ids in found]
        start = np.zeros(len(words), np.int64)
        start[~plain] = np.cumsum(size[~plain]) - size[~plain]
        if plain.any():
            # A blank behind each word tells where its ids end.
            low = " ".join([*words.filter(pa.array(plain)).to_pylist(), ""]).lower()
            merged = self._merge(_END.join([*_WORDS.findall(low), ""]), disallowed_special=())
            ends = np.flatnonzero(merged == self._blank)
            begins = np.concatenate(([0], ends[:-1] + 1))
            size[plain], start[plain] = ends - begins, begins + size[~plain].sum()
            found.append(merged)
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.stack((start, size))

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end_id`` behind each, and the offsets between texts."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        known, (start, size) = self._each(coded.dictionary)
        known, start, size = np.append(known, np.uint32(end_id)), np.append(start, len(known)), np.append(size, 1)
        words = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        code = np.insert(coded.indices.to_numpy(zero_copy_only=False), words, len(coded.dictionary))
        size = size[code]
        ends = np.cumsum(size)
        at = np.repeat(start[code] - (ends - size), size) + np.arange(size.sum())
        return known[at], np.concatenate(([0], ends[words + np.arange(len(words))]))


@lru_cache(maxsize=1)
def word_ids(vocabulary: str, ranks: frozenset[tuple[bytes, int]]) -> WordIds:
    """One for each Python worker, so that later tasks find the words of earlier ones."""
    return WordIds(vocabulary, ranks)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): the ids of each row's text and ``end_id``,
    in one piece, or in pieces of ``capacity`` when there are more."""
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, merge_ranks(vocabulary)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(*shared.value)
        for whole in batches:
            for low, high in stretches(buffers(whole.column("text"))[1], _STRETCH):
                batch = whole.slice(low, high - low)
                ids, at = words.ids(batch.column("text"), end_id)
                ids = ids.astype("<u4", copy=False)
                # Each text has an id at least, its end.
                number = -(-np.diff(at) // capacity)
                piece = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                first = np.repeat(at[:-1], number) + start
                length = np.minimum(capacity, np.repeat(at[1:], number) - first)
                body = memoryview(ids).cast("B")
                crc = [zlib.crc32(body[4 * x : 4 * (x + n)]) for x, n in zip(first.tolist(), length.tolist())]
                doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), number)))
                columns = [doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    bounds = pa.array(np.append(first, len(ids)).astype(np.int32))
                    columns, names = [*columns, pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts(docs).mapInArrow(cut, schema)


def _patterns(classes: int, parts: int) -> list[tuple[int, ...]]:
    """All ways to write ``classes`` as a falling sum of at most ``parts`` numbers."""
    found: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], rest: int, top: int) -> None:
        if rest == 0:
            found.append(head)
        elif len(head) < parts:
            for number in range(min(rest, top), 0, -1):
                grow((*head, number), rest - number, number)

    grow((), classes, classes)
    return found


def fit_non_negative(matrix: np.ndarray, goal: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares with no negative solution, by the active-set method: variables that would help most
    come in one by one, and those that a solution drives below zero leave."""
    x = np.zeros(matrix.shape[1])
    active = np.zeros(matrix.shape[1], dtype=bool)
    small = 1e-9 * max(1.0, np.abs(matrix.T @ goal).max(initial=0.0))
    for _ in range(rounds):
        gain = np.where(active, -np.inf, matrix.T @ (goal - matrix @ x))
        best = int(gain.argmax())
        if gain[best] <= small:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            trial = np.linalg.lstsq(matrix[:, at], goal, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[at] = trial
                break
            low = trial <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - trial[low], 1e-300))
            x[at] += step * (trial - x[at])
            gone = at[(x[at] <= 1e-12) & low]
            x[gone], active[gone] = 0, False
            if not len(gone):
                break
    return x


class _Packs:
    """Sequences under construction, by groups of equal content: lengths, room left, how many."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def add(self, lengths: tuple[int, ...], times: int) -> None:
        if times:
            self.by_room[self.capacity - sum(lengths)].append((lengths, times))

    def best_fit(self, length: int, count: int) -> None:
        """Places ``count`` pieces of one length where the least room stays, or in new sequences."""
        while count:
            room = next((r for r in range(length, self.capacity) if self.by_room.get(r)), None)
            if room is None:
                each = self.capacity // length
                self.add((length,) * each, count // each)
                self.add((length,) * (count % each), min(1, count % each))
                return
            lengths, times = self.by_room[room].pop()
            taken = min(times, count)
            self.add((*lengths, length), taken)
            self.add(lengths, times - taken)
            count -= taken


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths, how many sequences) that use up a histogram of lengths 1 to ``capacity``."""
    left = counts.astype(np.int64).copy()
    packs = _Packs(capacity)
    packs.add((capacity,), int(left[capacity]))
    left[capacity] = 0
    width = -(-capacity // _CLASSES)
    classes = -(-capacity // width)
    of = -(-np.arange(capacity + 1) // width)
    goal = np.bincount(of, weights=left, minlength=classes + 1)[1:].astype(float)
    patterns = _patterns(classes, _PARTS)
    matrix = np.zeros((classes, len(patterns)))
    for column, pattern in enumerate(patterns):
        for number in pattern:
            matrix[number - 1, column] += 1
    times = np.floor(fit_non_negative(matrix, goal) + 1e-6).astype(np.int64) if goal.any() else np.zeros(len(patterns), np.int64)

    def longest(low: int, high: int, used: list[int]) -> int | None:
        for length in range(min(high, capacity), max(low, 1) - 1, -1):
            if left[length] > used.count(length):
                return length
        return None

    for column in np.flatnonzero(times):
        pattern, repeat = patterns[column], int(times[column])
        while repeat:
            chosen: list[int] = []
            room = capacity
            for place, number in enumerate(pattern):
                least_after = sum((n - 1) * width + 1 for n in pattern[place + 1 :])
                last = place == len(pattern) - 1
                # The last one may come from a neighbouring class if it fills the room better.
                high = room if last else min(number * width, room - least_after)
                length = longest(max((number - 2) * width, 0) + 1 if last else (number - 1) * width + 1, high, chosen)
                if length is None:
                    break
                chosen.append(length)
                room -= length
            if len(chosen) < len(pattern):
                break
            turns = min(repeat, *(int(left[n]) // chosen.count(n) for n in set(chosen)))
            packs.add(tuple(chosen), turns)
            for length in chosen:
                left[length] -= turns
            repeat -= turns
    for length in range(capacity, 0, -1):
        packs.best_fit(length, int(left[length]))
    return [group for room in sorted(packs.by_room) for group in packs.by_room[room]]


def _places(groups: list[tuple[tuple[int, ...], int]], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For positions in the order of lengths: where a stretch starts, its first sequence and its offset."""
    free = np.concatenate(([0], np.cumsum(counts)))[:-1].tolist()
    rows, sequence = [], 0
    for lengths, times in groups:
        offset = 0
        for length in lengths:
            rows.append((free[length], sequence, offset))
            free[length] += times
            offset += length
        sequence += times
    found = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return found[:, 0].copy(), found[:, 1].copy(), found[:, 2].copy()


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: no gaps, no overlaps, at most ``capacity`` in a sequence.

    A null or empty text is its end id alone. Repeated rows and rows without an id are packed like
    any other, a piece each. Other columns are not read. No rows in, no rows out.
    """
    rows = kept(pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    shared = docs.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity), counts))
    schema = T.StructType([*rows.schema.fields]).add("sequence_id", T.LongType()).add("offset", T.LongType())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sequences, offsets = shared.value
        for batch in batches:
            position = np.asarray(batch.column("position"))
            at = np.searchsorted(starts, position, side="right") - 1
            columns = [batch.column(name) for name in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequences[at] + position - starts[at]), pa.array(offsets[at])], names=schema.names
            )

    sorted_rows = with_running_total(rows, ["length", "doc_id", "piece"], "length", "by-length").drop("before")
    return sorted_rows.mapInArrow(place, schema)

"""Token counts with a whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone; those that come back as one
token are proven whole. Every text is cut where the tokenizer's own splitting must cut (at white
space), and the pieces are split into pre-tokens by its pattern. Pre-tokens that are proven whole count as one
without further work; only the others are merged pair by pair, by tiktoken. Counts of pieces are remembered up to a
bound.

The vocabulary is read once by the driver and broadcast, its size does not depend on the data; the proof is made
once for each vocabulary and process.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import Remembered, buffers, letters_of_bytes, texts

#: Two neighbouring spaces, or one at an end: there the quick cuts would not be the tokenizer's.
_UNEVEN = re.compile(r"\s\s|^\s|\s\Z|[\x00\x1c-\x1f\x85]|[^\S \n]")
#: White space as the splitting rule has it (Python's own class has four signs more).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The cuts of that rule around white space: of a run before other signs all but the last is one piece,
#: the last goes with them if it is a blank and stands alone if not; a run at the end is one piece.
_CUTS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]+")
#: The splitting rule of the byte-level vocabulary (fixed value of the tokenizer), white space written out.
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Longer pieces of such a text (runs of white space, say) are not remembered.
_LONG = 256


@lru_cache(maxsize=4)
def whole_tokens(vocabulary: str) -> frozenset[str]:
    """Strings of a vocabulary (the text of a tokenizers file) that the library encodes alone as one token."""
    from tokenizers import Tokenizer

    library, byte = Tokenizer.from_str(vocabulary), letters_of_bytes()
    strings = set()
    for token in json.loads(vocabulary)["model"]["vocab"]:
        try:
            strings.add(bytes(byte[c] for c in token).decode("utf-8"))
        except (UnicodeDecodeError, KeyError):
            pass  # Part of a character: never a text of its own.
    ordered = sorted(strings)
    return frozenset(s for s, e in zip(ordered, library.encode_batch(ordered, add_special_tokens=False)) if len(e.ids) == 1)


class TokenCounter:
    """Counts the tokens of texts as the library does, for a byte-level vocabulary."""

    def __init__(self, vocabulary: str, whole: frozenset[str], remembered: int = 150_000) -> None:
        import tiktoken

        spec, byte = json.loads(vocabulary), letters_of_bytes()
        special = [t["content"] for t in spec["added_tokens"]]
        ranks = {
            bytes(byte[c] for c in token): number
            for token, number in spec["model"]["vocab"].items()
            if token not in special
        }
        # Only the merging of single pre-tokens is asked of it, so its own pattern is not used.
        self._merge = tiktoken.Encoding("counts", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._split = regex.compile(_SPLIT).findall
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._whole = whole
        self._counts = Remembered(self._piece, remembered)

    def _piece(self, piece: str) -> int:
        if piece in self._whole:
            return 1
        # A run of white space is one pre-token.
        parts = (piece,) if piece.isspace() else self._split(piece)
        return sum(1 if part in self._whole else len(self._merge(part)) for part in parts)

    def _ordinary(self, text: str) -> int:
        # A single blank goes with the word behind it, a single line feed stands alone: both begin a new
        # piece in every case. Where spaces meet, they are cut as the pattern does.
        if _UNEVEN.search(text):
            known = self._counts
            return sum(known[piece] if len(piece) < _LONG else self._piece(piece) for piece in _CUTS.findall(text))
        return sum(map(self._counts.__getitem__, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))

    def count(self, text: str) -> int:
        if self._special is None or not self._special.search(text):
            return self._ordinary(text)
        parts = self._special.split(text)
        return sum(map(self._ordinary, parts)) + len(parts) - 1


@lru_cache(maxsize=1)
def token_counter(vocabulary: str, whole: frozenset[str]) -> TokenCounter:
    """One for each Python worker, so that later tasks find the pieces of earlier ones."""
    return TokenCounter(vocabulary, whole)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Whole texts, no truncation, no tokens added; strings of special tokens inside a text count as
    those tokens, as the library does by default. A null text counts as empty (no bytes, no tokens).
    Repeated rows and rows without an id give a row each. Other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, whole_tokens(vocabulary)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(*shared.value)
        for batch in batches:
            sizes = np.diff(buffers(batch.column("text"))[1])
            numbers = np.fromiter(map(counter.count, batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(numbers)], names=["doc_id", "n_bytes", "n_tokens"]
            )

    counted = texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

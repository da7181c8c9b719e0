"""Token counts and packing against the library itself."""

from __future__ import annotations

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logharbor.llm import packing, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None,
    "",
    " ",
    "\n",
    "  two  blanks\n\nand lines \n x\t tab\r\nend ",
    "it's we'll I'M 'sa ''s don't!! 12 345 a1b2",
    "a<|endoftext|>b <|endoftext|> <|startoftext|>x<|endoftext|>",
    "Ünïcödé ß Σίσυφος ΣΑΣ İstanbul ﬁ ½ 漢字かな 한국어 é ̈x  nbsp  em ​zero",
    "zero\0byte \x1c\x1d\x85 \x0b\x0c",
    "word " * 3000,
    "x" * 20_000,
    "Emoji 👩‍👩‍👧 𝒳 ~~~ ### $$$ a_b",
]


def _random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    pool = "abcXYZ 's\n\t.,!0123éÉßñ漢́  \x1c\x00<|>endoftext"
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(TEXTS + _random_texts(300, 1)))
    rows.append((4, TEXTS[4]))  # a repeated row
    return spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, length string, piece double")


def test_counts_equal_the_library(docs):
    library = Tokenizer.from_file(BYTES)
    got = token_counts.token_counts(docs, BYTES).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for row in got:
        text = texts[row["doc_id"]]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 1024), text[:60]


def test_every_character_splits_as_in_the_library():
    """A letter, digit, space or sign of Unicode must end and begin pieces where the library has it."""
    with open(BYTES, encoding="utf-8") as file:
        vocabulary = file.read()
    counter = token_counts.TokenCounter(vocabulary, token_counts.whole_tokens(vocabulary))
    library = Tokenizer.from_file(BYTES)
    signs = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"ab{c}cd 12{c}34 {c}{c} {c}x" for c in signs]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    wrong = [(hex(ord(c)), counter.count(t), n) for c, t, n in zip(signs, texts, expected) if counter.count(t) != n]
    assert not wrong


def test_whole_tokens_are_proven():
    with open(BYTES, encoding="utf-8") as file:
        whole = token_counts.whole_tokens(file.read())
    assert " the" in whole and "the" in whole and len(whole) > 40_000


def test_remembered_counts_are_bounded():
    with open(BYTES, encoding="utf-8") as file:
        vocabulary = file.read()
    counter = token_counts.TokenCounter(vocabulary, frozenset(), remembered=10)
    library = Tokenizer.from_file(BYTES)
    for text in _random_texts(200, 2):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(counter._counts) <= 10 and len(counter._counts._older) <= 10


def test_packing_loses_nothing(docs):
    library = Tokenizer.from_file(WORDS)
    rows = packing.packed(docs, WORDS, capacity=64, with_ids=True).collect()
    expected = []
    for doc in docs.collect():
        ids = library.encode(doc["text"] or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            expected.append((doc["doc_id"], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted((*r[:5], list(r["ids"])) for r in rows) == sorted(expected)
    sequences: dict[int, list] = {}
    for row in rows:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.03 * -(-total // 64) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_any_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([1, 7, 64, 300, 2048]))
    counts = np.zeros(capacity + 1, np.int64)
    counts[1:] = rng.integers(0, 50, capacity) * (rng.random(capacity) < 0.5)
    used = np.zeros_like(counts)
    for lengths, times in packing.plan(counts, capacity):
        assert sum(lengths) <= capacity and times > 0
        for length in lengths:
            used[length] += times
    assert (used == counts).all()


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(5)
    counts = np.bincount(np.clip(rng.lognormal(6, 0.9, 50_000).astype(int), 1, 2048), minlength=2049)
    groups = packing.plan(counts, 2048)
    bound = max(-(-int((counts * np.arange(2049)).sum()) // 2048), int(counts[1025:].sum()))
    assert sum(times for _, times in groups) <= 1.005 * bound


def test_non_negative_fit():
    rng = np.random.default_rng(0)
    matrix = rng.random((12, 30))
    goal = matrix @ np.where(rng.random(30) < 0.3, rng.random(30), 0)
    x = packing.fit_non_negative(matrix, goal)
    assert (x >= 0).all() and np.linalg.norm(matrix @ x - goal) < 1e-6


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none, BYTES).count() == 0
    assert packing.packed(none, WORDS).count() == 0


@pytest.fixture(scope="module")
def byte_counter():
    with open(BYTES, encoding="utf-8") as file:
        vocabulary = file.read()
    return token_counts.TokenCounter(vocabulary, frozenset(token_counts.whole_tokens(vocabulary)))


def test_uneven_texts_take_the_whole_token_shortcut(byte_counter, monkeypatch):
    merged = []
    merge = byte_counter._merge
    monkeypatch.setattr(byte_counter, "_merge", lambda text: merged.append(text) or merge(text))
    text = " the day\n\n\n  and\t  the  night zqxj  \n"
    assert byte_counter.count(text) == len(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids)
    assert merged == [" zqxj"]


def test_white_space_is_cut_as_in_the_library(byte_counter):
    rng = random.Random(3)
    pool = ["a", "'s", "9", "!", "\x1c", "\x00", "​", *" \n\t\r\x0b\x85\xa0     　"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    expected = Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)
    assert [byte_counter.count(t) for t in texts] == [len(e.ids) for e in expected]


@pytest.mark.parametrize("text", ["\n" * 2_000_000, "a" + " \n" * 1_000_000 + "b"])
def test_two_million_signs_of_white_space(byte_counter, text):
    assert byte_counter.count(text) == len(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids)


def _ids_of(words, texts):
    ids, at = words.ids(pa.array(texts), 7)
    return [ids[low:high].tolist() for low, high in zip(at[:-1], at[1:])]


def test_every_plain_word_of_a_stretch_is_merged_in_one_call():
    with open(WORDS, encoding="utf-8") as file:
        vocabulary = file.read()
    words = packing.WordIds(vocabulary, packing.merge_ranks(vocabulary))
    calls, merge = [], words._merge
    words._merge = lambda text, **options: calls.append(text) or merge(text, **options)
    rng = random.Random(4)
    pool = "abcXYZ's  .,!09éÉßñ<|>漢\n\x01\t"
    texts = ["", " ", "It's ERHE.!! b'll", "<|endoftext|> a<|endoftext|>b", "x" * 100_000]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    expected = Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)
    assert _ids_of(words, texts) == [[*e.ids, 7] for e in expected]
    assert len(calls) == 1


def test_tokens_that_are_never_made_are_not_merged():
    with open(WORDS, encoding="utf-8") as file:
        spec = json.load(file)
    letters = sorted(spec["model"]["vocab"], key=spec["model"]["vocab"].get)[:512]
    # "abc" has a merge, but its "ab" is merged before; "cc" meets itself in runs.
    merges = [["a", "b"], ["b", "c"], ["a", "bc"], ["c", "c"], ["abc", "c</w>"], ["b", "c</w>"], ["cc", "a"]]
    spec["model"]["merges"] = merges
    spec["model"]["vocab"] = {token: i for i, token in enumerate([*letters, *("".join(m) for m in merges)])}
    spec["added_tokens"] = []
    vocabulary = json.dumps(spec)
    ranks = packing.merge_ranks(vocabulary)
    assert b"abc" not in dict(ranks) and b"bc\x01" in dict(ranks) and len(ranks) == 512 + 5
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc ") for _ in range(30)) for _ in range(500)]
    expected = [[*e.ids, 7] for e in Tokenizer.from_str(vocabulary).encode_batch(texts, add_special_tokens=False)]
    assert _ids_of(packing.WordIds(vocabulary, ranks), texts) == expected
    # Numbers that do not follow the merges leave everything to the library.
    spec["model"]["merges"] = merges[::-1]
    assert not packing.merge_ranks(json.dumps(spec))
    assert _ids_of(packing.WordIds(vocabulary, frozenset()), texts) == expected

"""Links of n-gram sets against all pairs."""

from __future__ import annotations

import random
import re

import pytest

from logharbor.llm import ngram_join
from tests.llm.brute import components


def _set(text, words):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    if not found:
        return set()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def expected(rows, words, percent):
    sets = {i: _set(t, words) for i, t in rows}
    links = {i: set() for i in sets}
    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            union = len(sets[a] | sets[b])
            if union and 100 * len(sets[a] & sets[b]) >= percent * union:
                links[a].add(b)
                links[b].add(a)
    label = components(links)
    return sorted((i, len(sets[i]), len(links[i]), label[i]) for i in sets)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 12, 60, 300]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
        text = " ".join(words)
        rows.append((i * 3, text.upper() if rng.random() < 0.2 else text.replace(" ", "\n\t") if rng.random() < 0.1 else text))
    rows += [(9001, None), (9002, ""), (9003, " \n "), (9004, "one"), (9005, "ONE"), (9006, "one two"), (9007, "Ä b"), (9008, "ä b")]
    return rows


@pytest.mark.parametrize("seed, words, percent, grams", [(0, 3, 90, 1 << 20), (1, 5, 80, 1 << 20), (2, 3, 90, 2048)])
def test_links_equal_all_pairs(spark, seed, words, percent, grams):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, weight int, keys string")
    got = ngram_join.linked_documents(frame, words, percent, grams).collect()
    assert sorted(map(tuple, got)) == expected(rows, words, percent)


def test_one_large_group(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[: i % 70] + [f"x{i}"] + base[i % 70 + 1 :])) for i in range(300)] + [(1000, " ".join(base))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.linked_documents(frame, 3, 90, 4096).collect()
    assert sorted(map(tuple, got)) == expected(rows, 3, 90)


def test_repeated_and_missing_ids(spark):
    text = "a b c d e f"
    frame = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.linked_documents(frame, 3, 90).collect()))
    assert got == [(1, 4, 1, 1), (2, 4, 1, 1)]


def test_no_rows(spark):
    assert ngram_join.linked_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_and_large_buckets_over_batches():
    """All pairs of small buckets and the chains of large ones, wherever a batch ends."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = sorted((int(k), int(n), i) for i, (k, n) in enumerate(zip(np.repeat([1, 2, 3, 4, 5], [3, 80, 1, 32, 33]), rng.integers(50, 60, 149))))
    for step in (1, 7, 40, 200):
        parts = [rows[i : i + step] for i in range(0, len(rows), step)]
        batches = [pa.RecordBatch.from_pydict({"key": [r[0] for r in p], "n": [r[1] for r in p], "doc_id": [r[2] for r in p]}) for p in parts]
        found = {tuple(x.values()) for b in ngram_join._bucket_pairs(80)(iter(batches)) for x in b.to_pylist()}
        for key in (1, 2, 3, 4, 5):
            docs = [r[2] for r in rows if r[0] == key]
            if len(docs) <= 32:
                assert {(min(a, b), max(a, b), None) for i, a in enumerate(docs) for b in docs[i + 1 :]} <= found
            else:
                pairs = {(min(a, b), max(a, b)) for a, b in zip(docs, docs[1:])}
                assert pairs <= {(min(a, b), max(a, b)) for a, b, k in found if k == key}


def _components(rows):
    return sorted((i, n, label) for i, n, _, label in rows)


@pytest.mark.parametrize("seed, percent, grams", [(0, 80, 1 << 20), (1, 80, 2048), (2, 60, 1024)])
def test_components_alone(spark, seed, percent, grams):
    """Many blocks, small and large buckets: components are those of all pairs."""
    rng = random.Random(seed)
    rows = corpus(seed)
    passage = [f"p{i}" for i in range(40)]
    rows += [(20_000 + i, " ".join(passage[: 30 + i % 9] + [f"own{i // 3}{k}" for k in range(12 + rng.randrange(30))])) for i in range(90)]
    rows += [(30_000 + i, " ".join([*passage[: rng.randrange(3)], *(f"n{k}" for k in range(60) if k != i % 60), f"z{i}"])) for i in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.linked_documents(frame, 5, percent, grams, count_links=False).collect()
    assert _components(map(tuple, got)) == _components(expected(rows, 5, percent))


def test_words_with_mirrored_patterns_share_nothing(spark):
    """Two words in Thue-Morse order, letters exchanged, agree in every polynomial modulo a power of two."""
    order = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, "".join("ab"[x] for x in order)), (2, "".join("ba"[x] for x in order)), (3, "a" * 300), (4, "a" * 299 + "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (90, 80):
        got = sorted(map(tuple, ngram_join.linked_documents(frame, 3, percent).collect()))
        assert got == [(i, 1, 0, i) for i in (1, 2, 3, 4)]


def test_very_long_texts(spark):
    base = [f"w{i % 977}x{i % 31}" for i in range(60_000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-40], "other"])), (3, "x" * 500_000), (4, "x" * 500_000), (5, None)]
    got = ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(map(tuple, got)) == expected(rows, 3, 90)


def test_word_numbers_tell_bytes_apart():
    import numpy as np

    from logharbor.llm.common import word_bounds, word_numbers

    rng = random.Random(1)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 7, 8, 9, 16, 17, 255, 256, 257, 600]))) for _ in range(3000)}
    words = sorted(words)
    data = np.frombuffer(" ".join([*words, *words]).encode(), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    for seed in (0, 1):
        numbers = word_numbers(data, starts, ends, seed)
        assert (numbers[: len(words)] == numbers[len(words) :]).all() and len(set(numbers.tolist())) == len(words)


def test_overlaps_of_sets():
    import numpy as np

    rng = np.random.default_rng(2)
    for n, most in ((12, 40), (40, 200), (3, 5)):
        sets = [np.unique(rng.integers(0, 60, rng.integers(0, most)).astype(np.uint64)) for _ in range(n)]
        sets += [sets[0]] * 6
        plain = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
        same = ngram_join._overlaps(sets, None, columns=7)
        off = ~np.eye(len(sets), dtype=bool)
        assert (same[off] == np.array(plain)[off]).all()
        assert ngram_join._overlaps(sets[:5], sets[5:], columns=7).tolist() == [row[5:] for row in plain[:5]]
    none = [np.zeros(0, np.uint64)] * 2
    assert ngram_join._overlaps(none, None).tolist() == [[0, 0], [0, 0]]

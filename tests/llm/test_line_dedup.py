"""Shared lines against a plain count."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from logharbor.llm import line_dedup

_WHITE = " \t\n\v\f\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(_WHITE))


def _expected(rows, min_docs, least_points):
    texts = {}
    for doc, text in rows:
        if doc is not None:
            texts[doc] = max(texts.get(doc, ""), text or "", key=lambda t: t.encode())
    count = Counter(k for t in texts.values() for k in {_key(line) for line in t.split("\n")})
    out = []
    for doc, text in texts.items():
        lines = text.split("\n")
        left = [x for x in lines if len(_key(x)) < max(1, least_points) or count[_key(x)] < min_docs]
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


def _rows():
    rng = random.Random(3)
    pool = ["Shared line", " shared LINE\t", "é", "É", "", "   ", "\x85 odd", "a", "b", "ab", "x\r", *(f"line {i}" for i in range(300))]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {i} {j}" for j in range(rng.randrange(12)))) for i in range(400)]
    rows += [(1000 + i, "Shared line\nkeep " + str(i)) for i in range(200)]  # a third of all rows
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (2003, "same\n" * 50), (2004, "long " * 40_000 + "\nshared line"), (None, "shared line")]
    rows += [(5, "zzz repeated id\nline 7"), (5, "aaa"), (6, None), (2003, "same\n" * 50)]
    return rows


@pytest.mark.parametrize(
    "options",
    [
        {"min_docs": 10},
        {"min_docs": 3, "shard_lines": 16},
        {"min_docs": 3, "shard_lines": 16, "broadcast_bytes": 0, "chunk_rows": 50},
        {"min_docs": 10, "broadcast_bytes": 0},
        {"min_docs": 1, "least_points": 2, "shard_lines": 100},
        {"min_docs": 2, "least_points": 2, "broadcast_bytes": 0, "chunk_rows": 7},
    ],
)
def test_against_a_plain_count(spark, options, monkeypatch):
    monkeypatch.setattr(line_dedup, "_HELD", 50)
    rows = _rows()
    frame = spark.createDataFrame([(d, t, 1, "k", 2) for d, t in rows], "doc_id long, text string, shard int, chunk string, n int").repartition(5)
    got = sorted(map(tuple, line_dedup.without_common_lines(frame, **options).collect()))
    assert got == _expected(rows, options["min_docs"], options.get("least_points", 1))


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for limit in (0, 1 << 20):
        assert line_dedup.without_common_lines(none, broadcast_bytes=limit).count() == 0


def test_index_counts_other_documents_lines(spark):
    docs = spark.createDataFrame([(i, f"all\npair {i // 2}\nown {i}") for i in range(40)], "doc_id long, text string")
    index, shards = line_dedup.line_index(docs, least=2, shard_lines=8)
    assert shards == 3 and index.count() == 3
    arrays = line_dedup.LineArrays(index.collect(), shards)
    asked = [b"all", b"pair 3", b"own 3", b"never seen"]
    import xxhash

    assert arrays.counts(b"".join(xxhash.xxh3_128_digest(k) for k in asked)).tolist() == [40, 2, 0, 0]


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (1, 2, 65, 5000):
        high, low = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 63, n).astype(np.uint64)
        low[: n // 3] = low[0]  # pairs that agree in one half
        levels, words = line_dedup.perfect_hash(high, low)
        row = {"shard": 0, "levels": levels, "words": words.astype("<u8").tobytes(), "prints": b"", "counts": b""}
        assert sorted(line_dedup.LineArrays([row], 1).slots(high, low).tolist()) == list(range(n))
    assert line_dedup.LineArrays([], 1).counts(b"x" * 16).tolist() == [0]

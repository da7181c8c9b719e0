"""Removed repeats against a table of all strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from logharbor.llm import suffix_dedup


def expected(rows, length):
    seen, out = set(), []
    for doc, text in sorted(rows):
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - length + 1):
            string = body[i : i + length]
            if string in seen:
                gone[i : i + length] = True
            seen.add(string)
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((doc, len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefg é\n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(80, 260))) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.6:
                p = rng.choice(passages)
                parts.append(p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)] if rng.random() < 0.7 else p)
            else:
                parts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 300))))
        rows.append((i * 2 + 1, "".join(parts)))
    rows += [(500, None), (501, ""), (502, "a" * 99), (503, "a" * 700), (504, "ab" * 400), (505, "xyz " * 150), (506, rows[3][1]), (4, rows[5][1])]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_removals_equal_all_strings(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, bucket string").repartition(5)
    got = sorted(map(tuple, suffix_dedup.without_repeats(frame).collect()))
    assert got == sorted(expected(rows, 100))


@pytest.mark.parametrize("few, many", [(2, 1000), (2, 4)])
def test_crowded_buckets(spark, few, many, monkeypatch):
    """One passage in all texts, with other neighbours each time; by cover ranks and by rows."""
    monkeypatch.setattr(suffix_dedup, "_MANY", many)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(130))
    rows = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(0, 150))) + passage[rng.randint(0, 10) :] + rng.choice("xyz") * rng.randint(0, 90)) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, suffix_dedup.without_repeats(frame).collect())) == sorted(expected(rows, 100))


def test_sorted_classes_are_equal_strings():
    rng = np.random.default_rng(2)
    around = rng.integers(97, 99, (300, 167)).astype(np.uint8)
    around[100:200, 30:150] = around[0, 30:150]
    for start, rank in suffix_dedup.sort_suffixes(around, 100, range(68)):
        strings = [row[start : start + 100].tobytes() for row in around]
        names = {}
        assert len(set(zip(strings, rank.tolist()))) == len(set(strings)) == len(set(rank.tolist())), names


def test_pieces_do_not_change_the_sample(monkeypatch):
    rng = np.random.default_rng(3)
    data, at = rng.integers(97, 101, 5000).astype(np.uint8), np.array([0, 50, 1200, 1290, 5000])
    whole = suffix_dedup.cover_sample(data, at, 100, 33)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 300)
    for a, b in zip(whole, suffix_dedup.cover_sample(data, at, 100, 33)):
        assert (a == b).all()


def test_no_rows(spark):
    assert suffix_dedup.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_buckets_are_not_copied_for_each_start(spark, monkeypatch):
    """Each member of a crowded bucket becomes a row for a few ranges of starts, not one for each start."""
    monkeypatch.setattr(suffix_dedup, "_MANY", 4)
    stored = []
    keep = suffix_dedup.kept
    monkeypatch.setattr(suffix_dedup, "kept", lambda df, purpose: stored.append((purpose, keep(df, purpose))) or stored[-1][1])
    rng = random.Random(7)
    word = "".join(rng.choice("abcdef ") for _ in range(95))
    rows = [(i, "".join(rng.choice("ghij") for _ in range(200)) + word + "".join(rng.choice("ghij") for _ in range(200))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, suffix_dedup.without_repeats(frame).collect())) == sorted(expected(rows, 100))
    rows_of = lambda name: sum(df.count() for purpose, df in stored if purpose == name)
    assert rows_of("around") >= 60 and 3 * rows_of("members") < 68 * rows_of("around")

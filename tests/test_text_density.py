from __future__ import annotations

import numpy as np
import pytest

from logharbor.operators import near_texts
from logharbor.operators.density import detect_density, detect_message_density
from logharbor.stopwords import ENGLISH

WORDS = "disk node cache queue retry login token shard index table lease quota".split()


def brute_force(texts, x, eps, least):
    """Labels, core flags: every pair of rows by its full distance."""
    words = [[w for w in (t or "").lower().split() if len(w) > 1 and w not in ENGLISH] for t in texts]
    terms = sorted({w for row in words for w in row})
    counts = np.array([[row.count(t) for t in terms] for row in words], float).reshape(len(texts), len(terms))
    weights = counts * (np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1)
    weights /= np.maximum(np.sqrt((weights**2).sum(1, keepdims=True)), 1e-300)
    points = np.hstack([weights, x])
    near = ((points[:, None] - points[None]) ** 2).sum(-1) <= eps * eps + 1e-12
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        for i in np.flatnonzero(core):
            label[i] = label[near[i] & core].min()
    for i in np.flatnonzero(~core):
        label[i] = label[near[i] & core].min() if (near[i] & core).any() else -1
    return label, core


@pytest.mark.parametrize("eps,block", [(0.5, 2_000), (0.9, 7)])
def test_text_and_numbers_against_all_pairs(spark, monkeypatch, eps, block):
    monkeypatch.setattr(near_texts, "_BLOCK", block)
    pick = np.random.default_rng(11)
    texts = [" ".join(["server", *pick.choice(WORDS, pick.integers(1, 5))] * 3 + list(pick.choice(WORDS, 1))) for _ in range(240)]
    texts += [texts[0]] * 30 + [None, "", "the of", "lonely words nobody repeats"] * 3
    x = np.round(pick.normal(0, 0.25, (len(texts), 3)), 2)
    label, core = brute_force(texts, x, eps, 5)
    frame = spark.createDataFrame(
        [(i, t, *map(float, row), "kept") for i, (t, row) in enumerate(zip(texts, x))],
        "line_number bigint, message string, a double, b double, c double, w string",
    )
    found = detect_density(frame, ["a", "b", "c"], eps, 5, text="message")
    assert found.columns == [*frame.columns, "is_core", "cluster_id", "anomaly_score", "is_anomaly"]
    got = {r["line_number"]: r for r in found.collect()}
    assert len(got) == len(texts)
    assert [got[i]["is_core"] for i in range(len(x))] == core.tolist()
    assert [got[i]["cluster_id"] for i in range(len(x))] == label.tolist()
    assert [got[i]["is_anomaly"] for i in range(len(x))] == [int(n == -1) for n in label]
    assert 1 < len(set(label.tolist())) and (label == -1).any()


def test_pairs_of_vectors_are_complete_and_unique(spark):
    pick = np.random.default_rng(3)
    rows = []
    for i in range(150):
        idx = np.sort(pick.choice(12, pick.integers(1, 6), replace=False))
        val = pick.uniform(0.2, 3, len(idx))
        rows.append((idx, val / np.sqrt((val * val).sum())))
    dense = np.zeros((150, 12))
    for i, (idx, val) in enumerate(rows):
        dense[i, idx] = val
    eps = 0.8
    least = 1 - eps * eps / 2
    heads = [int(np.argmax(np.append(np.cumsum((v * v)[::-1])[::-1], 0) < least**2 - 1e-9)) for _, v in rows]
    frame = spark.createDataFrame(
        [(i, (idx.tolist(), val.tolist(), h), float(i % 3), float(i % 3)) for i, ((idx, val), h) in enumerate(zip(rows, heads))],
        "vid bigint, _vector struct<idx: array<int>, val: array<double>, head: int>, lo0 double, hi0 double",
    )
    got = [(r["vid"], r["near_vid"]) for r in near_texts.near_vectors(frame, 1, eps).collect()]
    apart = ((dense[:, None] - dense[None]) ** 2).sum(-1)
    same = (np.arange(150)[:, None] - np.arange(150)[None]) % 3 == 0
    want = {(i, j) for i in range(150) for j in range(150) if i == j or (same[i, j] and apart[i, j] <= eps * eps)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_messages_with_nulls_and_an_empty_table(log_rows):
    rows = [("a", i, f"2024-01-01 0{i % 3}:00:00", "INFO", "job finished on worker") for i in range(12)]
    rows += [("a", 12, None, None, None), ("a", 13, "2024-01-01 00:00:00", "ERROR", "kernel panic in driver")]
    found = {r["line_number"]: r["is_anomaly"] for r in detect_message_density(log_rows(rows), eps=0.9).collect()}
    assert len(found) == 14 and found[12] == found[13] == 1
    assert detect_message_density(log_rows(rows).where("line_number < 0")).collect() == []


def test_eps_must_leave_room_for_the_terms(log_rows):
    with pytest.raises(ValueError):
        detect_message_density(log_rows([("a", 1, None, "INFO", "x")]), eps=1.0)


def test_vectors_of_equal_messages_are_equal_in_any_batch(spark):
    from pyspark.sql import functions as F

    from logharbor.operators.term_space import TermSpace

    pick = np.random.default_rng(5)
    rows = [(i, [str(w) for w in pick.choice(WORDS, pick.integers(0, 9))] + ["unknown"] * (i % 2)) for i in range(400)]
    frame = spark.createDataFrame([*rows, *((i + 1000, w[::-1]) for i, w in rows)], "id bigint, terms array<string>").repartition(7)
    space = TermSpace(10).fit(frame.where("id < 300"))
    kept = frame.withColumn("known", space.known_terms(frame)).withColumn("plain", space.vectors(frame))
    kept = kept.withColumn("short", space.vectors_of_known(kept, "known")).withColumn("v", near_texts.rarest_first(kept, space, "known", 0.9))
    got = {r["id"]: r for r in kept.collect()}
    order = np.lexsort((np.arange(space.size), -space.idf)).argsort()
    for i, words in rows:
        row = got[i]
        places = sorted(space.terms.index(w) for w in words if w in space.terms)
        assert np.frombuffer(row["known"], "<i4").tolist() == places
        assert row["short"] == row["plain"] and row["plain"]["idx"] == sorted(set(places))
        assert [row[c] for c in ("known", "plain", "v")] == [got[i + 1000][c] for c in ("known", "plain", "v")]
        idx, val, head = row["v"]
        assert idx == sorted(order[sorted(set(places))].tolist())
        behind = np.append(np.cumsum(np.square(val)[::-1])[::-1], 0.0)
        assert head == int(np.argmax(behind < 0.9**2 - 1e-9))
    assert kept.where(F.size("terms") == 0).count() > 0


def test_repeated_words_keep_one_vector_and_stay_together(spark):
    rows = [(i, " ".join(["quota"] * (1 + i % 3)), 0.0) for i in range(9)] + [(9, "lease table", 0.0)]
    found = detect_density(spark.createDataFrame(rows, "line_number bigint, message string, a double"), ["a"], 0.5, 9, text="message")
    assert {r["line_number"]: r["cluster_id"] for r in found.collect()} == {**{i: 0 for i in range(9)}, 9: -1}


def test_words_of_plain_and_other_texts(spark):
    from pyspark.sql import functions as F

    from logharbor.functions import text as X
    from logharbor.operators.tfidf import tokens

    texts = ["a bb_1 c3-dd ERR0R's x", "Ünïcödé ß straße 漢字 é̂e", "\tab\ncd\x01ef", "İstanbul I", "", "_ __ 1 22", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    wide = F.regexp_extract_all(F.lower("t"), F.lit(X.UNICODE + r"\b\w\w+\b"), F.lit(0))
    rows = frame.select(tokens(F.col("t"), []).alias("got"), wide.alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]

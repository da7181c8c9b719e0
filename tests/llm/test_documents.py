"""Exact copies, source mix, quality and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logharbor.llm import block_naming, common, quality, source_mix
from tests.llm.test_ngram_join import expected as expected_links

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, level int"


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _corpus(seed=0):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcABC é\n") for _ in range(rng.choice([0, 3, 50, 64, 65, 500, 3000]))) for _ in range(25)]
    texts = [rng.choice(base) for _ in range(150)] + [None, "", "É", "é", "a" * 64, "A" * 64, "a" * 128]
    return [(i, t, "en", None if i % 11 == 0 else f"s{min(i % 7, 3)}", 1, "x", 2) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [1, 16, 64, 4096])
def test_exact_groups(spark, block):
    rows = _corpus()
    if block == 1:
        rows = [r for r in rows if len(r[1] or "") < 70]
    got = block_naming.exact_groups(spark.createDataFrame(rows, DOCS), block).collect()
    groups = {}
    for r in rows:
        groups.setdefault(_lower(r[1]), []).append(r[0])
    expected = [(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_exact_groups_with_repeated_and_missing_ids(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "B"), (None, "b")], "doc_id long, text string")
    assert sorted(r[:4] for r in block_naming.exact_groups(frame).collect()) == [(1, 2, 2, False), (2, 2, 2, True)]
    assert [r["doc_id"] for r in block_naming.without_copies(frame).collect()] == [2]
    none = frame.limit(0)
    assert block_naming.exact_groups(none).count() == block_naming.without_copies(none).count() == 0


def _targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {s for s in names if not sizes[s]}
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3.0 * sizes[s]) for s in names}
        stopped |= over


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w \t" * rng.choice([0, 1, 5, 40]), "en", rng.choice([None, "a", "b", "c", "é", "z"]) if rng.random() < 0.7 else "a", 1, "x", 2) for i in range(600)]
    rows.append((601, None, "en", "only-empty", 1, "x", 2))
    frame = spark.createDataFrame(rows, DOCS)
    got = source_mix.mix(frame).collect()
    assert len(got) == len(rows)
    size = {r[0]: len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in rows}
    sources = {}
    for r in rows:
        sources[r[3]] = sources.get(r[3], 0) + size[r[0]]
    targets, taken = _targets(sources), dict.fromkeys(sources, 0)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sources[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["copies"] <= 3 and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
    for s in sources:
        assert abs(taken[s] - targets[s]) <= 40
    assert sorted(got) == sorted(source_mix.mix(frame.repartition(3)).collect())
    repeated = source_mix.mixed(frame).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in repeated} == {r["doc_id"]: r["copies"] for r in got if r["copies"]}
    assert source_mix.mixed(frame).columns == frame.columns


def test_mix_of_nothing(spark):
    assert source_mix.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_of_repeated_ids_and_clashing_names(spark):
    """Rows of one id are one row of the mix; columns may have any name."""
    rows = [(1, "a b c", "s", "en", 9), (1, "a b", "s", "en", 9), (2, "c " * 20, None, "en", 9), (None, "d", "s", "en", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string, copy int")
    got = source_mix.mixed(frame)
    assert got.columns == frame.columns
    assert {r["text"] for r in got.collect()} <= {"a b c", "c " * 20}
    assert [r["n"] for r in source_mix.mix(frame).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy("doc_id").collect()] == [1, 2, 1]
    odd = frame.withColumnsRenamed({"taken": "mark", "copy": "gone"})
    dropped = spark.createDataFrame([(2,)], "doc_id long")
    assert sorted(r["text"] for r in common.without_ids(odd.where("doc_id IS NOT NULL"), dropped).collect()) == ["a b", "a b c"]


def test_inclusion_against_a_plain_solution(spark):
    rng = random.Random(8)
    sizes = {s: [rng.choice([0, 1, 3, 10, 50, 400, 5000]) for _ in range(n)] for s, n in (("a", 80), ("b", 5), (None, 300), ("none", 3))}
    wanted = {"a": 3000.0, "b": 2.0, None: 4321.5, "none": 0.0}
    rows = [(s, i, size, wanted[s]) for s, held in sizes.items() for i, size in enumerate(held)]
    got = source_mix.inclusion(spark.createDataFrame(rows, "source string, i int, size long, wanted double")).collect()
    for s, held in sizes.items():
        fit = [x for x in held if 0 < x <= wanted[s]]
        low, high = 0.0, 1.0
        for _ in range(200):  # bisection for the scale
            c = (low + high) / 2
            low, high = (c, high) if sum(min(1.0, c * x) * x for x in fit) < wanted[s] else (low, c)
        for r in got:
            if r["source"] == s:
                p = min(1.0, high * r["size"]) if r["size"] in fit else 0.0
                assert r["p"] == pytest.approx(p, rel=1e-6, abs=1e-9)


def test_mix_with_long_documents_is_near_its_targets(spark):
    """Documents longer than what is wanted do not stand in the way, and long ones are likelier."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([3, 10, 200, 9000 if i % 40 == 0 else 30]), "en", f"s{i % 6}", 1, "x", 2) for i in range(900)]
    got = source_mix.mix(spark.createDataFrame(rows, DOCS)).collect()
    for s in range(6):
        mine = [r for r in got if r["source"] == f"s{s}"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(0.02 * mine[0]["target"], 200)
        # The share of documents of 200 words that got more copies than the least is above that of documents of 10.
        more = lambda size: [r["copies"] > min(m["copies"] for m in mine) for r in mine if r["size"] == size]
        if any(more(10)) or any(more(200)):
            assert sum(more(200)) / len(more(200)) >= sum(more(10)) / len(more(10))


def test_pareto_sample_keeps_inclusion_probabilities(spark):
    """Ranks by odds: a document with twice the probability is among the first about twice as often."""
    rows = spark.range(40_000).select(
        source_mix.pareto_rank(common.unit_interval(F.lit(1), F.col("id")), F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.4)).alias("rank"),
        (F.col("id") % 2).alias("odd"),
    )
    first = rows.orderBy("rank").limit(12_000).groupBy("odd").count().collect()
    count = {r["odd"]: r["count"] for r in first}
    assert count[0] == pytest.approx(4000, rel=0.06) and count[1] == pytest.approx(8000, rel=0.06)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = quality.scored(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    score, quality_ = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    good, bad = score[quality_ == 1], score[quality_ == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert {r["doc_id"] for r in got.where("held_out").collect()} == {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got.where("predicted = 1").collect()}


def test_quality_of_odd_rows(spark):
    texts = [None, "", " ", "a", "!!!", "a b c " * 20_000, "é", "a b", "a b"]
    docs = spark.createDataFrame([(i, t, 0, 0.5) for i, t in enumerate(texts)] + [(None, "x y", 0, 0.5)], "doc_id long, text string, good int, score double")
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.scored(docs, no_labels).collect()} == {0.5}
    assert quality.good_documents(docs, no_labels).count() == 10
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(1, None), (None, 1), (1, 1)], "doc_id long, quality int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_statistics_do_not_depend_on_the_batch():
    texts = ["", "One two two, THREE!", "a\nb | c", "é ü", "x" * 300, " ", "w w w w"]
    together = common.buffers(__import__("pyarrow").array(texts))
    rows = quality.statistics(*together)
    for i, text in enumerate(texts):
        alone = quality.statistics(*common.buffers(__import__("pyarrow").array([text])))
        assert np.allclose(rows[i], alone[0])
    repeats = quality.STATISTICS.index("repeats")
    assert rows[6, repeats] == 0.75 and rows[1, repeats] == 0


def test_isotonic_pools():
    x, y = quality.pooled(np.array([0, 3, 1, 0, 5.0]), np.array([4, 4, 4, 0, 5.0]), np.arange(5.0))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and len(x) == 3


def test_pipeline_stage_by_stage(spark):
    docs = common.table(spark, SF, "documents")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(common.kept(stage(spark, tables[-1], SF), name))
        if name != "packing":
            assert tables[-1].columns == docs.columns
    texts = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:5]]
    good, exact, near, mixed = texts[1:]
    assert set(good) <= set(texts[0])
    last = {}
    for i, t in good.items():
        last[_lower(t)] = max(i, last.get(_lower(t), i))
    assert set(exact) == set(last.values())
    assert set(near) == {i for i, _, _, c in expected_links(list(exact.items()), 5, 80) if i == c}
    assert set(mixed) <= set(near)
    times = {r["doc_id"]: r["count"] for r in tables[4].groupBy("doc_id").count().collect()}
    pieces = tables[5].where("start = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in pieces} == times and max(times.values()) <= 3
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.drop("sequence_id", "offset").collect())) == sorted(map(tuple, tables[5].drop("sequence_id", "offset").collect()))

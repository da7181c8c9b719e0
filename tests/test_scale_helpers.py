"""The bounded pieces give what one big window or sort would give."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from logharbor.functions import ordering as O
from logharbor.functions.stats import exact_quantiles, kth_smallest
from logharbor.operators.density import connected_components, detect_density
from logharbor.operators.features import with_log_frequency, with_time_diff
from logharbor.operators.neighbours import local_outlier_factor, nearest_neighbours, weighted_points
from logharbor.operators.sequence import sequence_scores
from logharbor.operators.service import rate_limit


@pytest.fixture(scope="module")
def bursty(spark):
    """One source has most rows; many equal times; some times are missing."""
    pick = random.Random(5)
    rows = []
    for i in range(600):
        source = "hot" if pick.random() < 0.7 else f"s{pick.randrange(3)}"
        at = None if pick.random() < 0.1 else pick.choice([30.0, pick.randrange(4000) / 2])
        word = pick.choice(["error", "start", "done", "finish", "warning"])
        rows.append((source, i + 1, at, f"{word} {i % 5}"))
    frame = spark.createDataFrame(rows, "source string, line_number bigint, at double, message string")
    return frame.selectExpr(
        "source", "line_number", "CAST(timestamp_micros(CAST(at * 1000000 AS BIGINT)) AS timestamp_ntz) AS timestamp", "message"
    ).persist()


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_time_diff_over_blocks(bursty):
    w = W.partitionBy("source").orderBy("line_number")
    plain = bursty.withColumn("p", F.lag("timestamp").over(w)).withColumn(
        "time_diff_seconds",
        F.coalesce(F.timestamp_diff("MICROSECOND", F.col("p"), F.col("timestamp")) / 1e6, F.lit(0.0)),
    )
    columns = ("source", "line_number", "time_diff_seconds")
    for block in (7, 100, 10_000):
        assert pairs(with_time_diff(bursty, block), *columns) == pairs(plain, *columns)


def test_log_frequency(bursty):
    rows = bursty.collect()
    stamps = [r["timestamp"].timestamp() for r in rows if r["timestamp"]]
    expected = sorted(
        (r["line_number"], sum(abs(r["timestamp"].timestamp() - s) <= 150 for s in stamps) if r["timestamp"] else 0)
        for r in rows
    )
    assert pairs(with_log_frequency(bursty), "line_number", "log_frequency_5min") == expected


def test_salted_lookup_spreads_heavy_keys(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 900, "a").when(F.col("id") < 990, "b").alias("k"))
    right = left.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    found = O.salted_lookup(left, right, ["k"], "n", ["id"], share=10, floor=10)
    assert found.count() == 1000
    assert {(r["k"], r["top"]) for r in found.select("k", "top").distinct().collect()} == {("a", 899), ("b", 989), (None, None)}


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("length", [2, 3, 5])
def test_sequence_pieces(bursty, partitions, length):
    few = bursty.where("line_number <= 60")
    rows = sorted(few.collect(), key=lambda r: (r["timestamp"] is not None, r["timestamp"] or 0, r["source"], r["line_number"]))
    kinds = {"error": "E", "start": "S", "done": "I", "finish": "F", "warning": "W"}
    types = [kinds[r["message"].split()[0]] for r in rows]
    grams = [tuple(types[i:i + length]) for i in range(len(types) - length + 1)]
    score = {}
    for i, r in enumerate(rows):
        cover = [1 - grams.count(grams[j]) / len(grams) for j in range(max(0, i - length + 1), i + 1) if j < len(grams)]
        score[r["line_number"]] = np.mean(cover) if cover else 0.0
    got = {r["line_number"]: r["anomaly_score"] for r in sequence_scores(few, length, partitions).collect()}
    assert got.keys() == score.keys()
    assert all(abs(got[k] - score[k]) < 1e-9 for k in score)


def test_running_total(spark):
    frame = spark.range(500).select(F.col("id").alias("v"), (F.col("id") % 7).alias("n"))
    got = {r["v"]: r["t"] for r in O.running_total(frame, "v", "n", "t", 9).collect()}
    total = 0
    for v in range(500):
        total += v % 7
        assert got[v] == total


@pytest.mark.parametrize("kind", ["spread", "ties"])
def test_exact_quantiles_by_brackets(spark, kind):
    pick = np.random.default_rng(3)
    values = pick.normal(size=4000) if kind == "spread" else np.where(pick.random(4000) < 0.6, 1.5, pick.integers(0, 9, 4000))
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for q in (0.0, 0.05, 0.5, 0.731, 0.95, 1.0):
        got = exact_quantiles(frame, "v", [q], small=50, accuracy=200)[0]
        assert got == pytest.approx(np.quantile(values, q), abs=1e-12)
    assert kth_smallest(frame, "v", 17, small=50) == np.sort(values)[16]
    assert exact_quantiles(frame.where("v > 1e9"), "v", [0.5]) == [None]


def test_connected_components(spark):
    pick = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + pick.randrange(50), 100 + pick.randrange(50)) for _ in range(35)]
    nodes = sorted({n for e in edges for n in e} | {999})
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = connected_components(
        spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(edges, "a bigint, b bigint")
    )
    assert {r["node"]: r["label"] for r in got.collect()} == label


@pytest.mark.parametrize("d", [1, 2, 3])
def test_density_against_brute_force(spark, d):
    pick = np.random.default_rng(d)
    x = np.round(np.vstack([pick.normal(0, 0.6, (60, d)), pick.normal(4, 0.5, (50, d)), pick.uniform(-6, 10, (25, d))]), 1)
    x = np.vstack([x, np.repeat(x[:1], 30, axis=0)])
    names = [f"f{i}" for i in range(d)]
    frame = spark.createDataFrame(
        [(i, *map(float, row)) for i, row in enumerate(x)], "line_number bigint, " + ", ".join(f"{n} double" for n in names)
    )
    eps, least = 0.55, 5
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        for i in np.flatnonzero(core):
            label[i] = label[near[i] & core].min()
    for i in np.flatnonzero(~core):
        label[i] = label[near[i] & core].min() if (near[i] & core).any() else -1
    got = {r["line_number"]: r for r in detect_density(frame, names, eps, least).collect()}
    assert [got[i]["cluster_id"] for i in range(len(x))] == label.tolist()
    assert [got[i]["is_core"] for i in range(len(x))] == core.tolist()
    assert all((got[i]["is_anomaly"] == 1) == (label[i] == -1) for i in range(len(x)))


def test_nearest_neighbours_and_lof(spark):
    pick = np.random.default_rng(8)
    x = np.round(np.vstack([pick.normal(0, 1, (500, 3)), pick.normal(8, 0.3, (120, 3)), [[30, 30, 30]]]), 3)
    x = np.vstack([x, x[:5], x[:5], x[:1]])
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id bigint, v array<double>")
    k = 7
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    points = weighted_points(frame, "id", "v")
    lists = {r["gid"]: r["neighbours"] for r in nearest_neighbours(points, k, block=64, queries=100).collect()}
    for gid, found in lists.items():
        flat = [e["d"] for e in found for _ in range(e["w"])]
        assert np.allclose(flat, np.sort(d[gid])[:k], atol=1e-9)
    scores = {r["id"]: r["anomaly_score"] for r in local_outlier_factor(frame, "id", "v", k, block=64).collect()}
    assert len(scores) == len(x)
    assert min(scores, key=scores.get) == 620
    inner = [-scores[i] for i in range(500) if np.linalg.norm(x[i]) < 1]
    assert 0.8 < np.median(inner) < 1.2
    assert scores[0] == scores[621]


@pytest.mark.parametrize("limit,seconds", [(2, 40), (5, 300), (1, 10)])
def test_rate_limit_against_a_loop(spark, limit, seconds):
    pick = random.Random(limit)
    rows, now = [], 0.0
    for i in range(900):
        now += pick.choice([0, 0, 0.5, 3, 60, 400]) if pick.random() < 0.5 else 1
        rows.append((i, "hot" if pick.random() < 0.7 else "cold", now))
    frame = spark.createDataFrame(rows, "request_id bigint, client_id string, s double").selectExpr(
        "request_id", "CAST(timestamp_micros(CAST(s * 1000000 AS BIGINT)) AS timestamp_ntz) AS ts", "client_id"
    )
    kept: dict[str, list[float]] = {}
    expected = []
    for i, client, at in rows:
        kept[client] = [t for t in kept.get(client, []) if at - t < seconds]
        expected.append((i, len(kept[client]) < limit))
        if expected[-1][1]:
            kept[client].append(at)
    assert pairs(rate_limit(frame, limit, seconds), "request_id", "allowed") == expected

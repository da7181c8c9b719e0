"""Near vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from logharbor.llm import cover_tree
from tests.llm.brute import components


def _expected(rows, at_least):
    sound = {}
    for name, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            sound[name] = x / np.linalg.norm(x)
    ids = list(sound)
    links = {name: set() for name, _ in rows}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sound[a] @ sound[b] >= at_least:
                links[a].add(b)
                links[b].add(a)
    label = components(links)
    return sorted((n, len(links[n]), label[n], label[n] == n) for n in links)


def _rows(seed, n=400, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    vectors = [rng.normal(size=width) if i % 3 else centres[i % 6] + rng.normal(size=width) * rng.choice([0.02, 0.1, 0.2]) for i in range(n)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # copies
    rows += [(2000, None), (2001, []), (2002, [0.0] * width), (2003, [float("nan")] + [1.0] * (width - 1))]
    rows += [(2004, [None] + [1.0] * (width - 1)), (2005, [float("inf")] * width), (2006, [2 * x for x in rows[0][1]])]
    return rows


@pytest.mark.parametrize("seed, block, at_least", [(0, 64, 0.95), (1, 4096, 0.95), (2, 50, 0.8), (3, 16, 0.99)])
def test_links_equal_all_pairs(spark, seed, block, at_least):
    rows = _rows(seed)
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, node int, weight int")
    got = cover_tree.near_vectors(frame, at_least, block).collect()
    assert sorted(map(tuple, got)) == _expected(rows, at_least)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cover_tree.near_vectors(none).count() == 0
    only_bad = spark.createDataFrame([(5, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, cover_tree.near_vectors(only_bad).collect())) == [(5, 0, 5, True)]


def test_tree_covers_and_nests():
    rng = np.random.default_rng(4)
    points = cover_tree._units(np.concatenate([rng.normal(size=(100, 5)), rng.normal(size=(1, 5)) + rng.normal(size=(100, 5)) * 0.05]))
    order, levels = cover_tree.build_tree(points, 0.04)
    assert sorted(order) == list(range(200))
    ordered, before = points[order], np.array([0])
    for starts, centres, radii in levels:
        ends = np.append(starts[1:], 200)
        for s, e, c, r in zip(starts, ends, centres, radii):
            assert s <= c < e and np.linalg.norm(ordered[s:e] - ordered[c], axis=1).max() <= r + 1e-12
        assert set(before) <= set(starts)
        before = starts


@pytest.mark.parametrize("chunk", [100, 20_000, 2_000_000])
def test_a_pair_of_nodes_beyond_the_chunk_is_walked_once(chunk):
    rng = np.random.default_rng(5)
    points = cover_tree._units(rng.normal(size=32) * 1.2 + rng.normal(size=(300 if chunk < 1_000_000 else 1500, 32)) * 0.3)
    order, levels = cover_tree.build_tree(points, 0.04)
    weights = rng.integers(1, 4, len(points))
    tree = cover_tree._Tree(points[order], weights[order], [{"starts": s, "centres": c, "radii": r} for s, c, r in levels])
    near = tree.points @ tree.points.T >= 0.95
    assert 0.02 < near.mean() < 0.98
    links_a, links_b, _ = cover_tree._meet(tree, tree, 0.95, False, chunk)
    assert (links_a == near @ tree.weights).all() and (links_b == near.T @ tree.weights).all()
    links, _, _ = cover_tree._meet(tree, tree, 0.95, True, chunk)
    np.fill_diagonal(near, False)
    assert (links == near @ tree.weights).all()


def test_links_of_a_dense_cluster(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=32) * 1.2 + rng.normal(size=(1500, 32)) * 0.3).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    units = cover_tree._units(vectors)
    expected = (units @ units.T >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in cover_tree.near_vectors(frame).collect()}
    assert [got[i] for i in range(len(vectors))] == expected.tolist()


@pytest.mark.parametrize("spread", [0.05, 0.25, 2.0])
def test_nodes_of_the_first_level_meet_as_points_do(spread):
    """Wide nodes, narrow ones and single points; few pairs of points in random directions are looked at one by one."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    trees = []
    for _ in range(2):
        points = cover_tree._units(centres[rng.integers(0, 30, 500)] + rng.normal(size=(500, 16)) * spread)
        limit = float(np.sqrt(0.1))
        order, levels = cover_tree.build_tree(points, limit / 8, limit)
        stretches = [{"starts": s, "centres": c, "radii": r} for s, c, r in levels]
        assert all(x["radii"].max() <= limit + 1e-6 for x in stretches)
        trees.append(cover_tree._Tree(points[order], np.ones(500, np.int64), stretches))
    a, b = trees
    near = a.points @ b.points.T >= 0.95
    links_a, links_b, _ = cover_tree._meet(a, b, 0.95, False)
    assert (links_a == near.sum(axis=1)).all() and (links_b == near.sum(axis=0)).all()

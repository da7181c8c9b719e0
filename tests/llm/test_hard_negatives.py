"""Hard negatives against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from logharbor.llm import hard_negatives


def _expected(rows, is_anchor, positives=5, negatives=3):
    sound = sorted((i, label, tuple(v)) for i, label, v in rows)
    out = []
    for anchor, label, v in sound:
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, other) for i, other, w in sound if i != anchor)
        for score, i, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(n, j) for n, j, other in scored if other != label and 50 * -score <= 100 * -n <= 95 * -score][:negatives]
            out += [(anchor, i, k + 1, j, -score, -n) for k, (n, j) in enumerate(fit)]
    return sorted(out)


def _rows(seed, n=600, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width)) * 40
    rows = [(i, int(rng.integers(0, 4)), [int(x) for x in np.floor(centres[i % 5] + rng.normal(size=width) * rng.choice([1, 10, 30]))]) for i in range(n)]
    rows += [(2000 + i, i % 3, rows[0][2]) for i in range(n // 2)]  # a third of all rows are one vector
    return rows + [(4000 + i, i % 2, [0] * width) for i in range(5)] + [(5000, 9, [50] * width), (-10, 0, [-40] * width)]


_SCHEMA = "vec_id long, label int, vector array<int>"


@pytest.mark.parametrize(
    "seed, options",
    [(0, {}), (1, {"codewords": 5, "shelf_rows": 40}), (2, {"codewords": 3, "shelf_rows": 1000, "anchors_a_task": 3}), (3, {"codewords": 1}), (4, {"codewords": 8, "shelf_rows": 7})],
)
def test_equals_all_pairs(spark, seed, options):
    rows = _rows(seed)
    frame = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], _SCHEMA + ", shelf int, cell int, score int").repartition(3)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, **options)
    assert sorted(map(tuple, got.collect())) == _expected(rows, lambda i: i % 10 == 0)


def test_odd_rows_take_no_part(spark):
    rows = _rows(5, 60)
    odd = [(9000, None, [1] * 6), (9010, 1, None), (9020, 1, [None] + [1] * 5), (9030, 1, []), (9040, 1, [90] * 7), (None, 1, [90] * 6), (*rows[3][:2], rows[3][2])]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows + odd, _SCHEMA), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == _expected(rows, lambda i: i % 10 == 0)


def test_few_or_no_rows(spark):
    for rows in ([], [(10, 1, [3, 4])], [(10, 1, [3]), (11, 1, [4]), (12, 2, [2])], [(10, 1, None)]):
        got = hard_negatives.hard_negatives(spark.createDataFrame(rows, _SCHEMA), F.col("vec_id") % 10 == 0).collect()
        assert sorted(map(tuple, got)) == _expected([r for r in rows if r[2]], lambda i: i % 10 == 0)


def test_cells_come_in_order_of_their_bounds():
    rng = np.random.default_rng(6)
    words = rng.normal(size=(7, 4)), rng.normal(size=(7, 4))
    radii = rng.random(7), rng.random(7)
    books = hard_negatives.Codebooks(words, radii, {c: (0, 0) for c in range(0, 49, 2)})
    vector = rng.normal(size=8)
    visited = list(books.in_order(books.bounds(vector)))
    bounds = [b for b, _ in visited]
    assert bounds == sorted(bounds, reverse=True) and sorted(c for _, c in visited) == list(range(0, 49, 2))
    for bound, cell in visited:
        exact = vector[:4] @ words[0][cell // 7] + np.linalg.norm(vector[:4]) * radii[0][cell // 7]
        exact += vector[4:] @ words[1][cell % 7] + np.linalg.norm(vector[4:]) * radii[1][cell % 7]
        assert exact <= bound <= exact + 0.01


def test_large_components_are_exact():
    x = np.array([[3.0e7, 2.0], [1.0, -3.0e7]])
    assert hard_negatives._products(x, x).tolist() == [[900000000000004, -30000000], [-30000000, 900000000000001]]
    big = np.array([[3.0e9, 1.0]])
    assert hard_negatives._products(big, big).tolist() == [[9000000000000000001]]

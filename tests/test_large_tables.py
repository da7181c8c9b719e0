"""What single tasks, broadcasts and the driver hold must not grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.operators import density as D
from logharbor.session import durable, shuffled, spread


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_cells_are_listed_by_block(spark):
    cells = spark.range(500).select(
        F.array(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(17)) - 8) for i in range(5)]).alias("cell"), F.col("id").alias("node")
    )
    for d, listed in ((1, 1), (4, 4), (5, 4)):
        listing = D._with_near_positions(cells, d, listed)
        assert listing.count() == 500 * 3**listed
        others = cells.select(D._position(d, listed).alias("position"), F.col("cell").alias("near_cell"), F.col("node").alias("other"))
        met = listing.join(others, "position").where(D._within_reach(d, listed) & (D._gap(d) <= d))
        wanted = cells.crossJoin(others.drop("position")).where(D._within_reach(d, listed) & (D._gap(d) <= d))
        pairs = [sorted((r["node"], r["other"]) for r in rows.select("node", "other").collect()) for rows in (met, wanted)]
        assert pairs[0] == pairs[1] and len(pairs[0]) >= 500


def test_density_clustering_broadcasts_no_cells(spark, monkeypatch):
    written = []
    monkeypatch.setattr(D, "durable", lambda df: written.append(_plan(df)) or durable(df))
    points = spark.range(3000).select(
        F.col("id").alias("gid"), F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 100.0 for i in range(4)]).alias("x"),
        F.lit(1).cast("bigint").alias("w"),
    )
    found = D.dbscan_points(points, 4, 1.0, 5)
    assert found.count() == 3000
    # Cells, their pairs and the points that meet; the rounds of the components are not among them.
    assert not any("BroadcastHashJoin" in plan for plan in written[:4])


def test_stored_rows_are_shuffled_on_request(spark):
    small = durable(spark.range(1000).select("id", F.array_repeat(F.lit(1), 1000).alias("a")))
    assert "BroadcastHashJoin" in _plan(spark.range(10).join(small, "id"))
    assert "SortMergeJoin" in _plan(spark.range(10).join(shuffled(small), "id"))


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    from logharbor.operators import supervised as S

    # One file, so one task would keep all rows.
    stored = durable(spark.range(20_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3 == 0).cast("double").alias("y")).coalesce(1))
    assert spread(stored, 20_000).rdd.getNumPartitions() == stored.rdd.getNumPartitions()
    sizes = spread(stored, 1000).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 1100
    seen = []
    fit = S.CrossValidator.fit
    monkeypatch.setattr(S, "_ROWS_PER_TASK", 1000)
    monkeypatch.setattr(S.CrossValidator, "fit", lambda self, data: seen.append(data.rdd.getNumPartitions()) or fit(self, data))
    S.GradientBoostingSearch(["x"], "y", trials=1, folds=2, estimators=(1, 1), depth=(1, 1)).fit(stored)
    assert seen == [20]


def test_terms_are_counted_in_bounded_pieces(spark, monkeypatch):
    from logharbor.operators import tfidf as T
    from logharbor.operators.term_space import hashed_terms

    monkeypatch.setattr(T, "_ROWS_PER_TASK", 500)
    texts = spark.range(20_000).select("id", F.concat(F.lit("alpha beta "), F.col("id").cast("string")).alias("text"))
    counted = T.term_counts(texts, ["id"], F.col("text"), bigrams=False)
    hashed = hashed_terms(texts.select("id", T.tokens(F.col("text")).alias("terms")), ["id"], "terms", 100_003)
    for rows in (counted, hashed):
        pieces = rows.groupBy(F.spark_partition_id()).agg(F.count_distinct("id").alias("n")).collect()
        assert len(pieces) == 40 and max(r["n"] for r in pieces) < 700


def test_frames_of_crowded_times_are_running_sums(spark):
    import numpy as np
    from logharbor.functions.ordering import centred_counts, trailing_counts
    from logharbor.operators.service import _near_crowded

    micros = np.random.default_rng(1).integers(0, 40_000_000, 1500).tolist() + [0, 10_000_000, 10_000_000, 20_000_000]
    rows = spark.createDataFrame([("c", int(m)) for m in micros], "client_id string, us bigint").selectExpr(
        "client_id", "CAST(timestamp_micros(us) AS timestamp_ntz) AS ts", "us"
    )
    at = np.sort(np.array(micros))
    trailing = trailing_counts(rows, "ts", 10, "load", ["client_id"])
    centred = centred_counts(rows, "ts", 5, "load")
    near = _near_crowded(trailing.withColumnRenamed("load", "_load"), 390, 10_000_000)
    for frame in (trailing, centred, near):
        plan = _plan(frame)
        assert "unboundedpreceding$(), currentrow$()" in plan and "RangeFrame, -" not in plan and "RangeFrame, 0" not in plan
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    for frame, low, high in ((trailing, -9_999_999, 0), (centred, -5_000_000, 5_000_000)):
        found = {r["us"]: (r["n"], r["load"]) for r in frame.select(us.alias("us"), "n", "load").collect()}
        wanted = {int(m): (int((at == m).sum()), int(((at >= m + low) & (at <= m + high)).sum())) for m in at}
        assert found == wanted
    loads = {int(m): ((at > m - 10_000_000) & (at <= m)).sum() for m in at}
    crowded = np.array(sorted(m for m, n in loads.items() if n > 390))
    assert 0 < len(crowded) < len(loads)
    wanted = {m for m in loads if ((crowded >= m) & (crowded <= m + 10_000_000)).any()}
    assert {r["_us"] for r in near.collect()} == wanted


def test_xml_files_are_bounded(spark, monkeypatch, tmp_path):
    from logharbor.sources import sinks

    monkeypatch.setattr(sinks, "_ELEMENTS_PER_FILE", 100)
    rows = spark.range(1000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("message")).coalesce(1)
    sinks._xml(rows, str(tmp_path / "rows"), "logs", "log_entry")
    assert len(list((tmp_path / "rows").glob("part-*"))) == 10
    again = spark.read.format("xml").option("rowTag", "log_entry").schema("id bigint, message string").load(str(tmp_path / "rows"))
    assert again.exceptAll(rows).isEmpty() and again.count() == 1000


def test_points_are_sent_to_shelves_not_cells(spark):
    import numpy as np
    import pandas as pd
    from logharbor.operators.neighbours import _closest, _distances, _shelves

    pick = np.random.default_rng(2)
    # A lattice has many ties, and far from the origin inner products are rough.
    b = pick.integers(0, 6, size=(900, 5)).astype(float) + 1e6
    near, d = _closest(b[:50], b, 21)
    all_of = _distances(b[:50], b)
    order = np.argsort(all_of, axis=1, kind="stable")[:, :21]
    assert (near == order).all() and (d == np.take_along_axis(all_of, order, axis=1)).all()
    cells = pd.DataFrame({"cell": np.arange(400), "points": np.full(400, 256)})
    shelves = _shelves(pick.normal(size=(400, 8)), cells, 4096)
    assert len(np.unique(shelves)) == 25 and np.bincount(shelves).max() * 256 <= 4096

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from logharbor.config import ConfigError, DetectorConfig
from logharbor.operators import features as E
from logharbor.operators.autoencoder import Autoencoder
from logharbor.operators.detector import AnomalyDetector
from logharbor.operators.isolation_forest import IsolationForest, IsolationForestModel, average_path
from logharbor.operators.nlp import detect_nlp
from logharbor.operators.one_class import OneClassSVM
from logharbor.operators.scoring import cut_by_contamination, majority_vote
from logharbor.operators.statistical import detect_statistical
from logharbor.operators.supervised import RandomForestDetector, heuristic_labels, refit_with_feedback
from logharbor.plans import views
from tests.conftest import SF


@pytest.fixture(scope="module")
def cloud(spark):
    pick = np.random.default_rng(4)
    rows = [("a", i, *map(float, pick.normal(size=3))) for i in range(2000)]
    rows += [("a", 2000 + i, 12.0 + i, -9.0, 15.0) for i in range(5)]
    return spark.createDataFrame(rows, "source string, line_number bigint, x double, y double, z double").persist()


NAMES = ["x", "y", "z"]


def test_forest_finds_planted_rows_and_survives_saving(spark, cloud, tmp_path):
    model = IsolationForest(NAMES, contamination=0.05).fit(cloud)
    found = model.transform(cloud).persist()
    worst = {r["line_number"] for r in found.orderBy("anomaly_score").limit(5).collect()}
    assert worst == {2000, 2001, 2002, 2003, 2004}
    share = found.agg(F.avg("is_anomaly")).first()[0]
    assert abs(share - 0.05) < 0.005
    low, high = found.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert -1 <= low < high < 0
    path = str(tmp_path / "forest")
    model.save(spark, path)
    again = IsolationForestModel.load(spark, path).transform(cloud)
    assert found.exceptAll(again).isEmpty()
    other = IsolationForest(NAMES, contamination=0.05).fit(cloud.repartition(3)).transform(cloud)
    assert found.exceptAll(other).isEmpty()
    assert abs(sum(model.feature_importance().values()) - 1) < 1e-9
    assert len(model.nodes) <= 100 * 511


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_one_class_share_and_far_rows(cloud):
    model = OneClassSVM(NAMES, nu=0.1).fit(cloud)
    found = model.transform(cloud)
    assert abs(found.agg(F.avg("is_anomaly")).first()[0] - 0.1) < 0.01
    assert found.where("line_number >= 2000").agg(F.min("is_anomaly")).first()[0] == 1


def test_autoencoder_learns(cloud):
    model = Autoencoder(NAMES, epochs=25, learning_rate=0.05).fit(cloud)
    assert model.losses[-1] < model.losses[0]
    found = model.transform(cloud)
    assert abs(found.agg(F.avg("is_anomaly")).first()[0] - 0.05) < 0.005
    assert abs(sum(model.feature_importance().values()) - 1) < 1e-9
    with pytest.raises(ValueError):
        Autoencoder(NAMES).transform(cloud)


def test_contamination_is_checked(cloud):
    for bad in (0, 0.5, 0.9, -1, "many", None):
        with pytest.raises(ConfigError):
            DetectorConfig(contamination=bad)
    assert cut_by_contamination(cloud, "x", "auto").where("is_anomaly = 1").count() == cloud.where("x < -0.5").count()
    assert DetectorConfig(algorithm="unheard of").algorithm == "isolation_forest"
    assert DetectorConfig.from_dict({"ml_model": {"n_estimators": 7, "other": 1}}).n_estimators == 7


def test_votes_round_half_to_even(spark):
    frame = spark.createDataFrame([(1, 0, 0.5, None)], "a int, b int, s double, t double")
    row = majority_vote(frame, ["a", "b"], ["s", "t"]).first()
    assert row["is_anomaly"] == 0 and row["anomaly_score"] == 0.25


def test_no_spread_and_empty_input(spark, log_rows):
    same = log_rows([("s", i, "2024-01-01 00:00:00", "INFO", "same text") for i in range(1, 9)])
    rows = detect_statistical(same).collect()
    assert all(r["anomaly_score"] == 0 and r["is_anomaly"] == 0 for r in rows)
    assert all(r["is_anomaly"] == 0 for r in detect_nlp(same).collect())
    empty = same.limit(0)
    assert detect_statistical(empty).count() == 0
    found = AnomalyDetector().fit_transform(empty)
    assert found.count() == 0 and {"is_anomaly", "anomaly_score", "confidence"} <= set(found.columns)


def test_unusable_columns(spark):
    frame = spark.createDataFrame([(i,) for i in range(3)], "wrong_column int")
    rows = AnomalyDetector().fit_transform(frame).collect()
    assert len(rows) == 3 and all(r["is_anomaly"] == 0 and r["confidence"] == 1.0 for r in rows)


@pytest.mark.parametrize("algorithm", ["isolation_forest", "one_class_svm", "local_outlier_factor"])
def test_general_detector(spark, algorithm):
    logs = views.app_logs(spark, SF).limit(300).persist()
    config = DetectorConfig(algorithm=algorithm, contamination=0.1, max_features=60, n_components=5, n_estimators=20)
    rows = AnomalyDetector(config).fit_transform(logs).collect()
    assert len(rows) == logs.count()
    assert 0.05 <= np.mean([r["is_anomaly"] for r in rows]) <= 0.15
    assert all(0 <= r["confidence"] <= 1 for r in rows)


def test_null_messages_keep_their_rows(spark, log_rows):
    rows = log_rows([("s", 1, None, None, None), ("s", 2, "2024-01-01 00:00:00", "ERROR", "a b")])
    first, second = E.with_text_shape(E.with_csv_enrichment(rows.withColumn("anomaly_score", F.lit(0.3))).select("source", "line_number", "timestamp", "level", "message")).orderBy("line_number").collect()
    assert (first["word_count"], first["hour"], first["day_of_week"], first["char_diversity"], first["special_char_ratio"]) == (5, 12, 3, 10, 0.1)
    assert (second["word_count"], second["severity_score"], second["char_diversity"]) == (2, 3, 3)
    basic = E.with_flags(E.with_basic_features(rows)).orderBy("line_number").first()
    assert (basic["message_length"], basic["word_count"], basic["severity_score"], basic["message_complexity"], basic["has_url"]) == (0, 0, 0, 0.0, 0)


def test_labels_are_capped(spark):
    logs = views.app_logs(spark, SF)
    n = logs.count()
    assert heuristic_labels(logs, 0.1).agg(F.sum("label")).first()[0] == int(n * 0.1)
    full = heuristic_labels(logs, 0.99).agg(F.sum("label")).first()[0]
    assert full == logs.where(
        "level IN ('ERROR','WARN') OR lower(message) rlike 'exception|critical|timeout|crash|fail' OR length(message) > "
        f"{logs.agg(F.percentile(F.length('message'), F.lit(0.95))).first()[0]}"
    ).count()


def test_forest_on_labels_and_feedback(spark, tmp_path):
    logs = views.app_logs(spark, SF).persist()
    detector = RandomForestDetector(n_estimators=5, max_depth=4)
    with pytest.raises(ValueError):
        detector.transform(logs)
    found = detector.fit(logs).transform(logs).persist()
    detector.save(str(tmp_path / "model"))
    again = RandomForestDetector().load(str(tmp_path / "model")).transform(logs)
    assert found.exceptAll(again).isEmpty()
    importance = detector.feature_importance()
    assert abs(sum(importance.values()) - 1) < 1e-6 and "level_value" in importance
    rows = E.with_basic_features(logs)
    feedback = rows.select("source", "line_number", F.lit(1).alias("prediction"), (F.col("level") == "ERROR").alias("correct"))
    key = ["source", "line_number"]
    assert refit_with_feedback(rows, feedback.limit(99), ["severity_score"], key) is None
    model = refit_with_feedback(rows, feedback, ["severity_score", "message_length"], key, trees=5)
    right = model.transform(rows).where(F.col("prediction") == (F.col("level") == "ERROR").cast("double")).count()
    assert right > 0.9 * logs.count()


def test_scored_rows_are_stored(spark, log_rows):
    """Scores are worked out once, not again for the cut, for the confidence and for the result."""
    from logharbor.operators.detector import AnomalyDetector, CoreDetector

    rows = log_rows([("s", i, "2024-01-01 10:00:00", "INFO", f"request {i % 7} served in time") for i in range(300)])
    settings = {"n_estimators": 5, "n_components": 3, "n_neighbors": 5}
    for found in (
        AnomalyDetector({"ml_model": settings}).fit_transform(rows),
        AnomalyDetector({"ml_model": {**settings, "algorithm": "ensemble"}}).fit_transform(rows),
        CoreDetector(0.05, n_estimators=5).fit_transform(rows),
    ):
        assert "EvalPython" not in found._jdf.queryExecution().toString()
        assert found.count() == 300


def test_forest_and_machine_of_one_feature(spark):
    rows = spark.createDataFrame([("s", i, float(i % 10) + (90.0 if i == 77 else 0.0)) for i in range(200)], "source string, line_number long, x double")
    for model in (IsolationForest(["x"], n_estimators=20, contamination=0.01).fit(rows), OneClassSVM(["x"], nu=0.01).fit(rows)):
        scores = {r["line_number"]: r["anomaly_score"] for r in model.transform(rows).collect()}
        assert min(scores, key=scores.get) == 77


def test_equal_rows_are_projected_alike(spark):
    """Whatever lies around a row, its components are the same to the last bit; equal vectors are grouped by them."""
    from logharbor.operators.reduction import PrincipalComponents

    rng = np.random.default_rng(3)
    rows = [(i, [0, 1, 2 + i % 50], [1.0, float(rng.normal()), 0.3]) for i in range(3000)]
    rows += [(-1 - i, [0, 1, 7, 30], [0.1, 0.2, 0.3, 0.7]) for i in range(3000) for _ in range(i % 2)]
    df = spark.createDataFrame(rows, "id long, idx array<int>, val array<double>").repartition(5)
    reduced = PrincipalComponents(60, 4).fit(df).transform(df)
    assert reduced.where("id < 0").select("reduced").distinct().count() == 1

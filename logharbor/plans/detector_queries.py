"""Detectors over the structured log, the embeddings and the labelled documents."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from logharbor.functions import vectors as V
from logharbor.functions.stats import fitted, profile, standard_scaled
from logharbor.functions.text import let, word_count
from logharbor.operators import features as E
from logharbor.operators.autoencoder import Autoencoder
from logharbor.operators.density import detect_density, detect_message_density
from logharbor.operators.isolation_forest import IsolationForest
from logharbor.operators.neighbours import exact_for, local_outlier_factor
from logharbor.operators.nlp import detect_nlp
from logharbor.operators.one_class import OneClassSVM
from logharbor.operators.sequence import detect_sequences
from logharbor.operators.statistical import detect_long_messages, detect_statistical
from logharbor.operators.supervised import (
    GradientBoostingSearch, RandomForestDetector, heuristic_labels, refit_with_feedback,
)
from logharbor.operators import scoring as Z
from logharbor.plans import views
from logharbor.plans.feature_queries import DOW, SEVERITY_CORE, rounded, sql, tfidf_cte
from logharbor.plans.parsing_queries import EVENT_TYPE_SQL, STATISTICAL_CTE, TEMPLATE_SQL
from logharbor.plans.registry import query

KEY = ["source", "line_number"]
FLAGS = [*KEY, "is_anomaly", "anomaly_score"]


@query(
    "detect_statistical",
    sql(STATISTICAL_CTE.replace("FROM logs", "FROM app_logs") + """SELECT source, line_number, is_anomaly,
  round(anomaly_score, 6) AS anomaly_score, round(z_score, 6) AS z_score, round(iqr_score, 6) AS iqr_score FROM detected"""),
)
def statistical(spark, sf_dir):
    rows = detect_statistical(views.app_logs(spark, sf_dir))
    return rounded(rows.select(*FLAGS, "z_score", "iqr_score"), "anomaly_score", "z_score", "iqr_score")


@query(
    "zscore_length",
    sql(""", s AS (SELECT avg(length(message)) AS m, stddev_samp(length(message)) AS sd FROM app_logs)
SELECT source, line_number, length(message) AS message_length, round(abs(length(message) - m) / sd, 6) AS anomaly_score,
  CAST(abs(length(message) - m) / sd > 2.0 AS INT) AS is_anomaly FROM app_logs, s"""),
)
def zscore_length(spark, sf_dir):
    rows = detect_long_messages(views.app_logs(spark, sf_dir))
    return rounded(rows.select(*FLAGS, "message_length"), "anomaly_score")


@query(
    "detect_sequence",
    sql(f""", t AS (SELECT source, line_number, timestamp, {EVENT_TYPE_SQL} AS e FROM app_logs),
g AS (SELECT *, CASE WHEN lead(e, 2) OVER w IS NOT NULL THEN concat_ws('>', e, lead(e, 1) OVER w, lead(e, 2) OVER w) END AS gram FROM t WINDOW w AS (ORDER BY timestamp, source, line_number)),
f AS (SELECT gram, count(*) / sum(count(*)) OVER () AS share FROM g WHERE gram IS NOT NULL GROUP BY gram),
j AS (SELECT g.*, f.share FROM g LEFT JOIN f USING (gram)),
s AS (SELECT source, line_number, coalesce(avg(1 - share) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS score,
  array_to_string(list_slice(list_filter([lag(gram, 2) OVER w, lag(gram, 1) OVER w, gram], lambda x: x IS NOT NULL), 1, 2), '; ') AS pattern_info
  FROM j WINDOW w AS (ORDER BY timestamp, source, line_number))
SELECT source, line_number, round(score, 6) AS anomaly_score, CAST(score > 0.8 AS INT) AS is_anomaly, pattern_info FROM s"""),
)
def sequence(spark, sf_dir):
    rows = detect_sequences(views.app_logs(spark, sf_dir))
    return rounded(rows.select(*FLAGS, "pattern_info"), "anomaly_score")


@query(
    "detect_nlp",
    sql(f""", tp AS (SELECT source, line_number, list_filter(string_split({TEMPLATE_SQL}, ' '), lambda x: x <> '') AS ws FROM app_logs),
wd AS (SELECT source, line_number, unnest(ws) AS word FROM tp),
wf AS (SELECT word, count(*) / sum(count(*)) OVER () AS share FROM wd GROUP BY word),
ra AS (SELECT source, line_number, avg(1 - share) AS rarity FROM wd JOIN wf USING (word) GROUP BY ALL)
""" + tfidf_cte(TEMPLATE_SQL, 1000, True) + """, ce AS (SELECT term, sum(weight) / (SELECT count(*) FROM app_logs) AS c FROM weights GROUP BY term),
di AS (SELECT source, line_number, 1 - sum(weight * c) / (SELECT sqrt(sum(c * c)) FROM ce) AS dist FROM weights JOIN ce USING (term) GROUP BY ALL),
bo AS (SELECT source, line_number, coalesce(rarity, 0.5) AS rarity, coalesce(dist, 1.0) AS dist FROM app_logs LEFT JOIN ra USING (source, line_number) LEFT JOIN di USING (source, line_number)),
mm AS (SELECT min(rarity) AS r0, max(rarity) AS r1, min(dist) AS d0, max(dist) AS d1 FROM bo),
sc AS (SELECT source, line_number, (rarity - r0) / (r1 - r0 + 1e-8) AS l, (dist - d0) / (d1 - d0 + 1e-8) AS s FROM bo, mm)
SELECT source, line_number, round(l, 6) AS linguistic_score, round(s, 6) AS semantic_score, round(0.6 * l + 0.4 * s, 6) AS anomaly_score,
  CAST(0.6 * l + 0.4 * s > 0.7 AS INT) AS is_anomaly FROM sc"""),
)
def nlp(spark, sf_dir):
    rows = detect_nlp(views.app_logs(spark, sf_dir))
    names = ["anomaly_score", "linguistic_score", "semantic_score"]
    return rounded(rows.select(*KEY, "is_anomaly", *names), *names)


# --- scores, votes and cuts ------------------------------------------------------

@query(
    "contamination_cut",
    views.with_views("votes", """SELECT line_number, score_a, CAST(score_a < (SELECT quantile_cont(score_a, 0.05) FROM votes) AS INT) AS is_anomaly FROM votes"""),
)
def contamination_cut(spark, sf_dir):
    rows = Z.cut_by_contamination(views.votes(spark, sf_dir), "score_a", 0.05)
    return rows.select("line_number", "score_a", "is_anomaly")


@query(
    "confidence",
    views.with_views("votes", """SELECT line_number, round(1 - (score_a - (SELECT min(score_a) FROM votes)) / ((SELECT max(score_a) - min(score_a) FROM votes) + 1e-8), 6) AS confidence FROM votes"""),
)
def confidence(spark, sf_dir):
    rows = Z.with_confidence(views.votes(spark, sf_dir), "score_a")
    return rounded(rows.select("line_number", "confidence"), "confidence")


@query(
    "vote_majority",
    views.with_views("votes", """SELECT line_number, CAST(vote_a + vote_b + vote_c >= 2 AS INT) AS is_anomaly,
  round((score_a + score_b + score_c) / 3, 6) AS anomaly_score FROM votes"""),
)
def vote_majority(spark, sf_dir):
    rows = Z.majority_vote(
        views.votes(spark, sf_dir), ["vote_a", "vote_b", "vote_c"], ["score_a", "score_b", "score_c"]
    )
    return rounded(rows.select("line_number", "is_anomaly", "anomaly_score"), "anomaly_score")


def _vote_sql(combined: str) -> str:
    scaled = ", ".join(
        f"(-score_{m} - (SELECT min(-score_{m}) FROM votes)) / ((SELECT max(-score_{m}) - min(-score_{m}) FROM votes) + 1e-8) AS {m}_score" for m in "abc"
    )
    return views.with_views("votes", f""", n AS (SELECT *, {scaled} FROM votes), c AS (SELECT *, ({combined}) / 3.0 AS raw FROM n),
r AS (SELECT *, (raw - (SELECT min(raw) FROM c)) / ((SELECT max(raw) - min(raw) FROM c) + 1e-8) AS anomaly_score FROM c),
t AS (SELECT quantile_cont(anomaly_score, 0.95) AS q FROM r)
SELECT line_number, round(anomaly_score, 6) AS anomaly_score, round(q, 6) AS ensemble_threshold, CAST(anomaly_score > q AS INT) AS is_anomaly,
  round(a_score, 6) AS a_score, round(b_score, 6) AS b_score, round(c_score, 6) AS c_score FROM r, t""")


_VOTE_COLUMNS = ["anomaly_score", "ensemble_threshold", "a_score", "b_score", "c_score"]


def _weighted(spark, sf_dir, strategy):
    members = {"a": "score_a", "b": "score_b", "c": "score_c"}
    rows = Z.weighted_vote(views.votes(spark, sf_dir), members, strategy=strategy)
    return rounded(rows.select("line_number", "is_anomaly", *_VOTE_COLUMNS), *_VOTE_COLUMNS)


@query("vote_soft", _vote_sql("a_score + b_score + c_score"))
def vote_soft(spark, sf_dir):
    return _weighted(spark, sf_dir, "soft")


@query("vote_hard", _vote_sql(" + ".join(f"CASE WHEN -score_{m} > 0.5 THEN 1.0 ELSE 0.0 END" for m in "abc")))
def vote_hard(spark, sf_dir):
    return _weighted(spark, sf_dir, "hard")


@query("explain_rows", views.with_views("logs", """SELECT line_number, CASE WHEN is_anomaly = 1 THEN 'Anomaly' ELSE 'Normal' END AS prediction, round(abs(anomaly_score), 6) AS decision_confidence FROM logs"""))
def explain_rows(spark, sf_dir):
    rows = Z.explain_rows(views.scored_logs(spark, sf_dir))
    return rounded(rows.select("line_number", "prediction", "decision_confidence"), "decision_confidence")


@query("detection_off", sql("SELECT line_number, 0 AS is_anomaly, CAST(0 AS DOUBLE) AS anomaly_score FROM app_logs"))
def detection_off(spark, sf_dir):
    return Z.without_detection(views.app_logs(spark, sf_dir)).select("line_number", "is_anomaly", "anomaly_score")


# --- neighbours and density --------------------------------------------------------

@query(
    "detect_lof",
    """WITH g AS (SELECT vec_id, embedding::DOUBLE[] AS v, min(vec_id) OVER (PARTITION BY embedding) AS gid FROM embeddings),
d AS (SELECT a.vec_id AS p, b.vec_id AS o, list_distance(a.v, b.v) AS d, b.gid AS og FROM g a JOIN g b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, og, o) AS r FROM d),
n AS (SELECT * FROM r WHERE r <= 20), k AS (SELECT p, max(d) AS kd FROM n GROUP BY p),
l AS (SELECT n.p, 1.0 / (avg(greatest(k.kd, n.d)) + 1e-10) AS lrd FROM n JOIN k ON k.p = n.o GROUP BY n.p),
f AS (SELECT n.p, -avg(lo.lrd) / any_value(lp.lrd) AS s FROM n JOIN l lo ON lo.p = n.o JOIN l lp ON lp.p = n.p GROUP BY n.p)
SELECT p AS vec_id, round(s, 6) AS anomaly_score, CAST(s < (SELECT quantile_cont(s, 0.05) FROM f) AS INT) AS is_anomaly FROM f""",
)
def detect_lof(spark, sf_dir):
    rows = local_outlier_factor(views.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=20)
    flagged = Z.cut_by_contamination(rows, "anomaly_score", 0.05, costly=True)
    return rounded(flagged.select("vec_id", "anomaly_score", "is_anomaly"), "anomaly_score")


_GRID = ["message_length", "severity_score", "hour", "day_of_week"]


def _scaled_logs(spark, sf_dir, columns=_GRID):
    rows = E.with_basic_features(views.app_logs(spark, sf_dir)).select(*KEY, *columns)
    stats = fitted(profile(rows, columns, quartiles=False))
    scaled = [standard_scaled(F.col(c), stats[f"{c}_mean"], stats[f"{c}_std"]).alias(c) for c in columns]
    return rows.select(*KEY, *scaled)


@query(
    "detect_dbscan",
    sql(f""", f AS (SELECT line_number, length(message) AS a, {SEVERITY_CORE} AS b, hour(timestamp) AS c, {DOW} AS d FROM app_logs),
s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc, avg(d) AS md, stddev_pop(d) AS sd FROM f),
p AS (SELECT line_number, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c, (d - md) / sd AS d FROM f, s),
u AS (SELECT a, b, c, d, count(*) AS w FROM p GROUP BY ALL),
k AS (SELECT x.a, x.b, x.c, x.d, sum(y.w) >= 5 AS core FROM u x JOIN u y ON x.b = y.b AND abs(x.d - y.d) <= 0.5 AND (x.a-y.a)*(x.a-y.a) + (x.b-y.b)*(x.b-y.b) + (x.c-y.c)*(x.c-y.c) + (x.d-y.d)*(x.d-y.d) <= 0.25 GROUP BY ALL),
z AS (SELECT x.a, x.b, x.c, x.d, bool_or(y.core) AS reached FROM k x JOIN k y ON x.b = y.b AND (x.a-y.a)*(x.a-y.a) + (x.b-y.b)*(x.b-y.b) + (x.c-y.c)*(x.c-y.c) + (x.d-y.d)*(x.d-y.d) <= 0.25 GROUP BY ALL)
SELECT line_number, core AS is_core, CAST(NOT reached AS INT) AS is_anomaly, CASE WHEN reached THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS anomaly_score
FROM p JOIN k USING (a, b, c, d) JOIN z USING (a, b, c, d)"""),
)
def detect_dbscan(spark, sf_dir):
    """Length, severity, hour and weekday, scaled; the severities lie more than eps apart."""
    rows = detect_density(_scaled_logs(spark, sf_dir), _GRID, eps=0.5, min_samples=5)
    return rows.select("line_number", "is_core", "is_anomaly", "anomaly_score")


_FIVE = [*_GRID, "word_count"]


@query(
    "detect_dbscan_five",
    sql(f""", f AS (SELECT line_number, length(message) AS a, {SEVERITY_CORE} AS b, hour(timestamp) AS c, {DOW} AS d, len(string_split(message, ' ')) AS e FROM app_logs),
s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc, avg(d) AS md, stddev_pop(d) AS sd, avg(e) AS me, stddev_pop(e) AS se FROM f),
p AS (SELECT line_number, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c, (d - md) / sd AS d, (e - me) / se AS e FROM f, s),
u AS (SELECT a, b, c, d, e, count(*) AS w FROM p GROUP BY ALL),
k AS (SELECT x.a, x.b, x.c, x.d, x.e, sum(y.w) >= 5 AS core FROM u x JOIN u y ON x.b = y.b AND (x.a-y.a)*(x.a-y.a) + (x.c-y.c)*(x.c-y.c) + (x.d-y.d)*(x.d-y.d) + (x.e-y.e)*(x.e-y.e) <= 0.25 GROUP BY ALL),
z AS (SELECT x.a, x.b, x.c, x.d, x.e, bool_or(y.core) AS reached FROM k x JOIN k y ON x.b = y.b AND (x.a-y.a)*(x.a-y.a) + (x.c-y.c)*(x.c-y.c) + (x.d-y.d)*(x.d-y.d) + (x.e-y.e)*(x.e-y.e) <= 0.25 GROUP BY ALL)
SELECT line_number, core AS is_core, CAST(NOT reached AS INT) AS is_anomaly, CASE WHEN reached THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS anomaly_score
FROM p JOIN k USING (a, b, c, d, e) JOIN z USING (a, b, c, d, e)"""),
)
def detect_dbscan_five(spark, sf_dir):
    """One more feature than the coordinates whose near cells are listed."""
    rows = detect_density(_scaled_logs(spark, sf_dir, _FIVE), _FIVE, eps=0.5, min_samples=5)
    return rows.select("line_number", "is_core", "is_anomaly", "anomaly_score")


@query("dbscan_clusters")
def dbscan_clusters(spark, sf_dir):
    """Size of every cluster; checked against brute force in the tests."""
    rows = detect_density(_scaled_logs(spark, sf_dir), _GRID, eps=0.5, min_samples=5)
    return rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_core").alias("core_rows")
    )


@query(
    "detect_dbscan_text",
    "WITH RECURSIVE " + sql(tfidf_cte("message", 1000, False) + f""", f AS (SELECT source, line_number, length(message) AS a, CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2 WHEN 'ERROR' THEN 3 ELSE 1 END AS b,
  hour(timestamp) AS c, {DOW} AS d FROM app_logs),
s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc, avg(d) AS md, stddev_pop(d) AS sd FROM f),
l AS (SELECT source, line_number, sum(weight * weight) AS n2 FROM weights GROUP BY ALL),
p AS (SELECT line_number, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c, (d - md) / sd AS d, coalesce(n2, 0) AS n2 FROM f CROSS JOIN s LEFT JOIN l USING (source, line_number)),
m AS (SELECT x.line_number AS i, y.line_number AS j, x.n2 + y.n2 + (x.a-y.a)*(x.a-y.a) + (x.c-y.c)*(x.c-y.c) + (x.d-y.d)*(x.d-y.d) AS q
  FROM p x JOIN p y ON x.b = y.b AND abs(x.a-y.a) <= 0.5 AND abs(x.c-y.c) <= 0.5 AND abs(x.d-y.d) <= 0.5 AND (x.a-y.a)*(x.a-y.a) + (x.c-y.c)*(x.c-y.c) + (x.d-y.d)*(x.d-y.d) <= 0.25),
dots AS (SELECT i, j, sum(x.weight * y.weight) AS dot FROM m JOIN weights x ON x.line_number = i JOIN weights y ON y.line_number = j AND y.term = x.term GROUP BY ALL),
near AS MATERIALIZED (SELECT i, j FROM m LEFT JOIN dots USING (i, j) WHERE q - 2 * coalesce(dot, 0) <= 0.25 + 1e-12),
k AS MATERIALIZED (SELECT i FROM near GROUP BY i HAVING count(*) >= 5),
e AS MATERIALIZED (SELECT i, j FROM near WHERE i IN (FROM k) AND j IN (FROM k)),
r(i, j) AS (SELECT i, i FROM k UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i),
names AS (SELECT i, min(j) AS name FROM r GROUP BY i),
found AS (SELECT near.i, min(name) AS name FROM near JOIN names ON names.i = near.j GROUP BY near.i)
SELECT line_number, k.i IS NOT NULL AS is_core, CAST(coalesce(own.name, found.name, -1) AS BIGINT) AS cluster_id, CAST(found.name IS NULL AS INT) AS is_anomaly,
  CASE WHEN found.name IS NULL THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS anomaly_score
FROM p LEFT JOIN k ON k.i = line_number LEFT JOIN names own ON own.i = line_number LEFT JOIN found ON found.i = line_number""").removeprefix("WITH "),
)
def detect_dbscan_text(spark, sf_dir):
    """Words of the message beside length, level, hour and weekday; the levels lie more than eps apart."""
    rows = detect_message_density(views.app_logs(spark, sf_dir))
    return rows.select("line_number", "is_core", "cluster_id", "is_anomaly", "anomaly_score")


@query(
    "embedding_cosine",
    """SELECT a.vec_id, b.vec_id AS next_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def embedding_cosine(spark, sf_dir):
    """Similarity of each vector to the one that follows it."""
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("a"))
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("a").alias("b"))
    pairs = rows.join(following, "vec_id")
    return rounded(
        pairs.select("vec_id", "next_id", V.cosine_similarity(F.col("a"), F.col("b")).alias("similarity")), "similarity"
    )


# --- trained detectors ----------------------------------------------------------------

@query(
    "rf_labels",
    sql(""", q AS (SELECT quantile_cont(length(message)::DOUBLE, 0.95) AS p, count(*) AS n FROM app_logs),
m AS (SELECT line_number, level IN ('ERROR', 'WARN') OR length(message) > p OR regexp_matches(lower(message), 'exception|critical|timeout|crash|fail') AS hit, n FROM app_logs, q),
o AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY md5(line_number::VARCHAR)) AS r, count(*) FILTER (hit) OVER () AS c FROM m)
SELECT line_number, CAST(CASE WHEN hit AND (c <= n * 0.1 OR r <= floor(n * 0.1)) THEN 1 ELSE 0 END AS INT) AS label FROM o"""),
)
def rf_labels(spark, sf_dir):
    return heuristic_labels(views.app_logs(spark, sf_dir)).select("line_number", "label")


_FOREST = ["message_length", "word_count", "severity_score", "hour", "day_of_week"]


@query("detect_isolation_forest")
def isolation_forest(spark, sf_dir):
    rows = E.with_basic_features(views.app_logs(spark, sf_dir))
    model = IsolationForest(_FOREST, contamination=0.05).fit(rows)
    return rounded(model.transform(rows).select(*FLAGS), "anomaly_score")


@query("detect_random_forest")
def random_forest(spark, sf_dir):
    logs = views.app_logs(spark, sf_dir)
    detector = RandomForestDetector().fit(logs)
    return rounded(detector.transform(logs).select(*FLAGS), "anomaly_score")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    detector = RandomForestDetector().fit(views.app_logs(spark, sf_dir))
    return detector.importance_table(spark)


@query("detect_autoencoder")
def autoencoder(spark, sf_dir):
    rows = E.with_text_shape(views.app_logs(spark, sf_dir))
    found = Autoencoder().fit(rows).transform(rows)
    return rounded(found.select(*FLAGS, "reconstruction_error"), "anomaly_score", "reconstruction_error")


@query("detect_ocsvm")
def one_class(spark, sf_dir):
    rows = E.with_basic_features(views.app_logs(spark, sf_dir))
    found = OneClassSVM(_FOREST, nu=0.05).fit(rows).transform(rows)
    return rounded(found.select(*FLAGS), "anomaly_score")


_DOCUMENT = ["n_chars", "words", "diversity", "digits"]


def _documents(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id")
    text = F.col("text")
    distinct = F.size(F.array_distinct(F.split(F.lower(text), r"\s+")))
    return documents.select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        word_count(text).cast("double").alias("words"),
        (distinct / F.greatest(word_count(text), F.lit(1))).alias("diversity"),
        (F.length(F.regexp_replace(text, r"\D", "")) / F.greatest(F.length(text), F.lit(1))).alias("digits"),
        F.col("quality").cast("double").alias("quality"),
    )


@query("automl_gbt")
def automl_gbt(spark, sf_dir):
    """Boosted trees for the document quality label; a short search."""
    rows = _documents(spark, sf_dir)
    search = GradientBoostingSearch(
        _DOCUMENT, "quality", trials=2, estimators=(3, 6), depth=(2, 4)
    ).fit(rows)
    return rounded(search.transform(rows).select("doc_id", "is_anomaly", "anomaly_score"), "anomaly_score")


@query("feedback_refit")
def feedback_refit(spark, sf_dir):
    """Every second flag of the statistical detector checked against the scored log."""
    from pyspark.ml.functions import vector_to_array

    rows = E.with_basic_features(views.scored_logs(spark, sf_dir).drop("anomaly_score"))
    guesses = detect_statistical(views.app_logs(spark, sf_dir)).select(
        *KEY, F.col("is_anomaly").alias("prediction")
    )
    feedback = rows.join(guesses, KEY).select(
        *KEY, "prediction", (F.col("prediction") == F.col("is_anomaly")).alias("correct")
    )
    model = refit_with_feedback(rows, feedback, _FOREST, KEY)
    scored = model.transform(rows).select(
        *KEY, F.col("prediction").cast("int").alias("is_anomaly"),
        vector_to_array("probability")[1].alias("anomaly_score"),
    )
    return rounded(scored, "anomaly_score")


@query("detect_general")
def general(spark, sf_dir):
    """All features, reduction, scaling and an isolation forest, at the defaults of the detector."""
    from logharbor.operators.detector import AnomalyDetector

    found = AnomalyDetector().fit_transform(views.app_logs(spark, sf_dir))
    return rounded(found.select(*FLAGS, "confidence"), "anomaly_score", "confidence")


@query("detect_vote")
def vote(spark, sf_dir):
    """Isolation forest, one-class SVM and local outlier factor on all features, two of three, at the defaults."""
    from logharbor.config import DetectorConfig
    from logharbor.operators.detector import AnomalyDetector

    found = AnomalyDetector(DetectorConfig(algorithm="ensemble")).fit_transform(views.app_logs(spark, sf_dir))
    return rounded(found.select(*FLAGS, "confidence"), "anomaly_score", "confidence")


@query("feature_importances")
def feature_importances(spark, sf_dir):
    """Share of splits of an isolation forest, weights of an autoencoder, gains of a random forest."""
    logs = views.app_logs(spark, sf_dir)
    models = {
        "isolation_forest": IsolationForest(_FOREST, contamination=0.05).fit(E.with_basic_features(logs)),
        "autoencoder": Autoencoder().fit(E.with_text_shape(logs)),
        "random_forest": RandomForestDetector().fit(logs),
    }
    return rounded(Z.importance_table(spark, models), "importance")


@query("detect_core")
def core(spark, sf_dir):
    """Length, a hundred terms, severity and clock, standard scaled, and an isolation forest."""
    from logharbor.operators.detector import CoreDetector

    found = CoreDetector(contamination=0.05).fit_transform(views.app_logs(spark, sf_dir))
    return rounded(found.select(*FLAGS), "anomaly_score")


def _term_vectors(spark, sf_dir):
    """Log rows as sparse unit vectors of at most 5,000 terms, and the number of terms."""
    from logharbor.operators.term_space import TermSpace
    from logharbor.operators.tfidf import tokens, with_bigrams
    from logharbor.session import durable

    rows = views.app_logs(spark, sf_dir).select(*KEY, let(tokens(F.coalesce("message", F.lit(""))), with_bigrams).alias("terms"))
    rows = durable(rows)
    space = TermSpace(5000, min_df=2, max_df=0.95).fit(rows)
    return durable(rows.withColumn("_v", space.vectors(rows)).select(*KEY, "_v.idx", "_v.val")), space.size


@query("reduce_terms")
def reduce_terms(spark, sf_dir):
    """Fifty principal components of up to 5,000 terms: variance of each and the share of all variance up to it."""
    from logharbor.operators.reduction import PrincipalComponents, total_variance

    vectors, size = _term_vectors(spark, sf_dir)
    fitted_ = PrincipalComponents(size, 50).fit(vectors)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(fitted_.variance)], "component int, variance double")
    shares = rows.crossJoin(F.broadcast(vectors.select(total_variance(vectors).alias("total")).limit(1)))  # fifty rows, one number
    upto = F.sum("variance").over(W.orderBy("component"))
    return rounded(shares.select("component", "variance", (upto / F.col("total")).alias("share")), "variance", "share")


@query("neighbours_recall")
def neighbours_recall(spark, sf_dir):
    """Twenty neighbours by random projections of all embeddings, held against the exact ones of every twentieth."""
    from logharbor.operators.neighbours import projected_neighbours, weighted_points
    from logharbor.session import durable

    rows = views.table(spark, sf_dir, "embeddings")
    points = durable(weighted_points(rows, "vec_id", "embedding"))
    found = projected_neighbours(points, 20).select("gid", F.explode("neighbours").alias("e")).select("gid", F.col("e.gid").alias("other"))
    some = points.where("gid % 20 = 0").select("gid", "vec")
    exact = durable(exact_for(some, points, 20))
    met = exact.join(found, ["gid", "other"], "left_semi").agg(F.count(F.lit(1)).alias("met"))
    wanted = exact.agg(F.count(F.lit(1)).alias("wanted"))
    both = met.select("met", wanted.scalar().alias("wanted"))
    return both.select("wanted", (F.col("met") >= 0.9 * F.col("wanted")).alias("recall_reached"))

"""Report data sets over logs that carry ``is_anomaly`` and ``anomaly_score``."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.operators import report as R
from logharbor.plans import views
from logharbor.plans.feature_queries import DOW, rounded
from logharbor.plans.registry import query


def sql(body: str) -> str:
    return views.with_views("logs", body)


_RATE = "100.0 * count(*) FILTER (is_anomaly = 1) / count(*)"


@query(
    "summary_stats",
    sql(f"""SELECT count(*) AS total_logs, count(*) FILTER (is_anomaly = 1) AS anomaly_count, round({_RATE}, 6) AS anomaly_percentage,
  count(*) FILTER (level = 'ERROR') AS error_count, count(*) FILTER (level IN ('WARN','WARNING')) AS warn_count,
  count(*) FILTER (level = 'INFO') AS info_count, min(timestamp) AS first_time, max(timestamp) AS last_time FROM logs"""),
)
def summary_stats(spark, sf_dir):
    return rounded(R.summary(views.scored_logs(spark, sf_dir)), "anomaly_percentage")


@query(
    "processing_statistics",
    sql(f"SELECT count(*) AS processed, count(*) FILTER (is_anomaly = 1) AS anomalies, round({_RATE}, 6) AS anomaly_rate FROM logs"),
)
def processing_statistics(spark, sf_dir):
    return rounded(R.processing_statistics(views.scored_logs(spark, sf_dir)), "anomaly_rate")


@query(
    "level_distribution",
    sql("SELECT level, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_percent FROM logs GROUP BY level"),
)
def level_distribution(spark, sf_dir):
    return rounded(R.level_distribution(views.scored_logs(spark, sf_dir)), "share_percent")


_HOURLY = """SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, count(*) FILTER (is_anomaly = 1) AS anomalies, count(*) AS total FROM logs GROUP BY 1"""


@query("hourly_timeline", sql(_HOURLY))
def hourly_timeline(spark, sf_dir):
    return R.hourly_timeline(views.scored_logs(spark, sf_dir))


@query(
    "hourly_timeline_dense",
    sql(f""", h AS ({_HOURLY}), hours AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour)
SELECT hours.hour, coalesce(anomalies, 0) AS anomalies, coalesce(total, 0) AS total FROM hours LEFT JOIN h USING (hour)"""),
)
def hourly_timeline_dense(spark, sf_dir):
    return R.hourly_timeline_dense(views.scored_logs(spark, sf_dir))


def _bins(value: str, bins: int) -> str:
    return f"CAST(least(coalesce(floor(({value} - lo) / nullif(hi - lo, 0) * {bins}), 0), {bins - 1}) AS BIGINT)"


@query(
    "length_histogram",
    sql(f""", v AS (SELECT CAST(length(message) AS DOUBLE) AS x, is_anomaly FROM logs), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT {_bins('x', 30)} AS bin, is_anomaly, count(*) AS n, round(any_value(lo) + {_bins('x', 30)} * (any_value(hi - lo) / 30), 6) AS bin_start FROM v, e GROUP BY lo, hi, bin, is_anomaly"""),
)
def length_histogram(spark, sf_dir):
    return rounded(R.length_histogram(views.scored_logs(spark, sf_dir)), "bin_start")


@query(
    "score_histogram",
    sql(f""", v AS (SELECT anomaly_score AS x FROM logs), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT {_bins('x', 20)} AS bin, lo, hi FROM v, e)
SELECT bin, count(*) AS n, round(any_value(lo) + bin * (any_value(hi - lo) / 20), 6) AS bin_start FROM b GROUP BY bin"""),
)
def score_histogram(spark, sf_dir):
    return rounded(R.score_histogram(views.scored_logs(spark, sf_dir)), "bin_start")


@query(
    "level_anomaly_rate",
    sql(f"SELECT level, count(*) AS total, count(*) FILTER (is_anomaly = 1) AS anomalies, round({_RATE}, 2) AS anomaly_rate FROM logs GROUP BY level"),
)
def level_anomaly_rate(spark, sf_dir):
    return R.level_anomaly_rate(views.scored_logs(spark, sf_dir))


@query(
    "anomaly_score_stats",
    sql("""SELECT round(avg(anomaly_score), 6) AS mean_score, round(median(anomaly_score), 6) AS median_score,
  round(max(anomaly_score), 6) AS max_score, round(min(anomaly_score), 6) AS min_score FROM logs WHERE is_anomaly = 1"""),
)
def anomaly_score_stats(spark, sf_dir):
    stats = R.anomaly_score_stats(views.scored_logs(spark, sf_dir))
    return rounded(stats, *stats.columns)


def _clock(part: str, name: str, source: str = "logs") -> str:
    return f"""SELECT {name}, n, {name} = (SELECT {name} FROM c_{name} ORDER BY n DESC, {name} LIMIT 1) AS is_peak,
  {name} = (SELECT {name} FROM c_{name} ORDER BY n, {name} LIMIT 1) AS is_quiet"""


def _clock_cte(part: str, name: str, where: str = "") -> str:
    return f"c_{name} AS (SELECT CAST({part} AS BIGINT) AS {name}, count(*) AS n FROM logs {where} GROUP BY 1)"


_DAY_NAMES = "[" + ", ".join(f"'{d}'" for d in K.DAY_NAMES) + "]"


@query("hour_pattern", sql(", " + _clock_cte("hour(timestamp)", "hour") + _clock("", "hour") + " FROM c_hour"))
def hour_pattern(spark, sf_dir):
    return R.hour_pattern(views.scored_logs(spark, sf_dir))


@query(
    "weekday_pattern",
    sql(", " + _clock_cte(DOW, "day_of_week") + _clock("", "day_of_week") + f", {_DAY_NAMES}[day_of_week + 1] AS day_name FROM c_day_of_week"),
)
def weekday_pattern(spark, sf_dir):
    return R.weekday_pattern(views.scored_logs(spark, sf_dir))


@query(
    "anomaly_patterns",
    sql(", " + _clock_cte("hour(timestamp)", "hour", "WHERE is_anomaly = 1") + ", " + _clock_cte(DOW, "day_of_week", "WHERE is_anomaly = 1") + f"""
SELECT 'hour' AS kind, hour AS position, NULL::VARCHAR AS day_name, n, hour = (SELECT hour FROM c_hour ORDER BY n DESC, hour LIMIT 1) AS is_peak FROM c_hour
UNION ALL SELECT 'weekday', day_of_week, {_DAY_NAMES}[day_of_week + 1], n,
  day_of_week = (SELECT day_of_week FROM c_day_of_week ORDER BY n DESC, day_of_week LIMIT 1) FROM c_day_of_week"""),
)
def anomaly_patterns(spark, sf_dir):
    return R.anomaly_patterns(views.scored_logs(spark, sf_dir))


_TREND = """d AS (SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM logs GROUP BY 1),
t AS (SELECT round(regr_slope(n::DOUBLE, x::DOUBLE), 6) AS slope, count(*) AS days FROM (SELECT n, row_number() OVER (ORDER BY day) - 1 AS x FROM d)),
trend AS (SELECT slope, days, CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM t WHERE days > 1)"""


@query("daily_trend", sql(f", {_TREND} SELECT slope, days, direction FROM trend"))
def daily_trend(spark, sf_dir):
    return R.daily_trend(views.scored_logs(spark, sf_dir))


def _season(kind: str, part: str) -> str:
    return f"""SELECT '{kind}' AS kind, stddev_samp(n) / avg(n) AS strength, stddev_samp(n) > 0.1 * avg(n) AS detected
  FROM (SELECT {part} AS p, count(*) AS n FROM logs GROUP BY 1)"""


_SEASON = f"season AS ({_season('hourly', 'hour(timestamp)')} UNION ALL {_season('weekly', DOW)})"


@query("seasonality", sql(f", {_SEASON} SELECT kind, round(strength, 6) AS strength, detected FROM season"))
def seasonality(spark, sf_dir):
    return rounded(R.seasonality(views.scored_logs(spark, sf_dir)), "strength")


@query(
    "anomaly_hours_24",
    sql("""SELECT h.hour, count(l.hour) AS anomalies FROM (SELECT unnest(range(24)) AS hour) h
LEFT JOIN (SELECT hour(timestamp) AS hour FROM logs WHERE is_anomaly = 1) l USING (hour) GROUP BY h.hour"""),
)
def anomaly_hours_24(spark, sf_dir):
    return R.anomaly_hours(views.scored_logs(spark, sf_dir))


@query(
    "time_findings",
    sql(", " + _clock_cte("hour(timestamp)", "hour") + ", " + _clock_cte(DOW, "day_of_week") + f""", {_TREND}, {_SEASON},
a AS (SELECT hour(timestamp) AS hour, count(*) AS n FROM logs WHERE is_anomaly = 1 GROUP BY 1),
f AS (SELECT (SELECT hour FROM c_hour ORDER BY n DESC, hour LIMIT 1) AS ph, (SELECT day_of_week FROM c_day_of_week ORDER BY n DESC, day_of_week LIMIT 1) AS pd,
  (SELECT direction FROM trend) AS dir, (SELECT detected FROM season WHERE kind = 'hourly') AS sh, (SELECT detected FROM season WHERE kind = 'weekly') AS sw,
  (SELECT strength FROM season WHERE kind = 'hourly') AS st, (SELECT hour FROM a ORDER BY n DESC, hour LIMIT 1) AS ah)
SELECT (SELECT min(timestamp) FROM logs) AS start_time, (SELECT max(timestamp) FROM logs) AS end_time,
  round(date_diff('microsecond', (SELECT min(timestamp) FROM logs), (SELECT max(timestamp) FROM logs)) / 3.6e9, 6) AS duration_hours,
  concat_ws(' | ', 'Peak activity occurs at ' || ph || ':00 hours', 'Highest log volume on ' || {_DAY_NAMES}[pd + 1], 'Overall trend: ' || dir,
    CASE WHEN sh THEN 'Strong hourly seasonality detected' END, CASE WHEN sw THEN 'Weekly pattern identified' END) AS key_findings,
  concat_ws(' | ', 'Monitor system closely around ' || ah || ':00 hours', CASE WHEN st > 0.5 THEN '{K.TIME_ADVICE_SEASONAL}' END,
    CASE WHEN dir = 'increasing' THEN '{K.TIME_ADVICE_GROWTH}' END, '{K.TIME_ADVICE_ALWAYS}') AS recommendations FROM f"""),
)
def time_findings(spark, sf_dir):
    rows = rounded(R.time_findings(views.scored_logs(spark, sf_dir)), "duration_hours")
    for name in ("key_findings", "recommendations"):
        rows = rows.withColumn(name, F.array_join(name, " | "))
    return rows


def _texts(values) -> str:
    return " | ".join(values)


@query(
    "risk_level",
    sql(f""", s AS (SELECT {_RATE} AS a, 100.0 * count(*) FILTER (level = 'ERROR') / count(*) AS e FROM logs),
r AS (SELECT a, e, CASE WHEN a > 10 THEN 'HIGH' WHEN a > 5 THEN 'MEDIUM' ELSE 'LOW' END AS s1, CASE WHEN a >= 10 THEN 'HIGH' WHEN a >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS s2 FROM s)
SELECT round(a, 6) AS anomaly_rate, round(e, 6) AS error_rate, s1 AS summary_risk, s2 AS executive_risk,
  concat_ws(' | ', CASE s1 WHEN 'HIGH' THEN '{_texts(K.SUMMARY_ADVICE['HIGH'])}' WHEN 'MEDIUM' THEN '{_texts(K.SUMMARY_ADVICE['MEDIUM'])}' ELSE '{_texts(K.SUMMARY_ADVICE['LOW'])}' END,
    CASE WHEN e > 5 THEN '{K.ERROR_RATE_ADVICE}' END) AS summary_advice,
  concat_ws(' | ', CASE s2 WHEN 'HIGH' THEN '{_texts(K.EXECUTIVE_ADVICE['HIGH'])}' WHEN 'MEDIUM' THEN '{_texts(K.EXECUTIVE_ADVICE['MEDIUM'])}' ELSE '{_texts(K.EXECUTIVE_ADVICE['LOW'])}' END,
    '{K.EXECUTIVE_ADVICE_ALWAYS}') AS executive_advice,
  CASE s2 WHEN 'HIGH' THEN '{K.RISK_DESCRIPTIONS['HIGH']}' WHEN 'MEDIUM' THEN '{K.RISK_DESCRIPTIONS['MEDIUM']}' ELSE '{K.RISK_DESCRIPTIONS['LOW']}' END AS risk_description FROM r"""),
)
def risk_level(spark, sf_dir):
    rows = rounded(R.risk_level(views.scored_logs(spark, sf_dir)), "anomaly_rate", "error_rate")
    for name in ("summary_advice", "executive_advice"):
        rows = rows.withColumn(name, F.array_join(name, " | "))
    return rows


@query(
    "executive_impact",
    sql("""SELECT count(*) FILTER (is_anomaly = 1 AND level = 'ERROR') AS error_anomalies,
  count(*) FILTER (is_anomaly = 1 AND level = 'WARNING') AS warning_anomalies FROM logs"""),
)
def executive_impact(spark, sf_dir):
    return R.executive_impact(views.scored_logs(spark, sf_dir))


_COMPLIANCE = f"""SELECT count(*) AS total_entries, count(*) FILTER (is_anomaly = 1) AS anomalies, {_RATE} AS anomaly_rate,
  count(*) FILTER (regexp_matches(lower(message), 'auth|login|fail')) AS auth_events, count(*) FILTER (level = 'ERROR') AS error_events,
  count(*) FILTER (is_anomaly = 1 AND regexp_matches(lower(message), 'security|auth|access')) AS security_anomalies FROM logs"""


@query("compliance_counts", sql(f"SELECT * REPLACE (round(anomaly_rate, 6) AS anomaly_rate) FROM ({_COMPLIANCE})"))
def compliance_counts(spark, sf_dir):
    return rounded(R.compliance_counts(views.scored_logs(spark, sf_dir)), "anomaly_rate")


@query(
    "compliance_findings",
    sql(f""", c AS ({_COMPLIANCE})
SELECT 'HIGH' AS severity, 'Monitoring' AS category, format('High anomaly rate detected: {{:.2f}}%', anomaly_rate) AS description,
  '{K.FINDING_MONITORING}' AS recommendation FROM c WHERE anomaly_rate > 10
UNION ALL SELECT 'MEDIUM', 'Error Handling', format('High error rate detected: {{}} errors in {{}} logs', error_events, total_entries),
  '{K.FINDING_ERRORS}' FROM c WHERE error_events > 0.05 * total_entries"""),
)
def compliance_findings(spark, sf_dir):
    return R.compliance_findings(views.scored_logs(spark, sf_dir))


_SHOWN = "line_number, source, timestamp, level, message, is_anomaly, round(anomaly_score, 6) AS anomaly_score"


@query(
    "top_anomalies",
    sql(f""", t AS (SELECT * FROM logs WHERE is_anomaly = 1 ORDER BY logs.anomaly_score DESC, source, line_number LIMIT 10)
SELECT {_SHOWN}, row_number() OVER (ORDER BY t.anomaly_score DESC, source, line_number) <= 5 AS is_recent_alert FROM t"""),
)
def top_anomalies(spark, sf_dir):
    """Top 10; the first five of them are the recent alerts of the dashboard."""
    from pyspark.sql import Window as W

    top = R.top_anomalies(views.scored_logs(spark, sf_dir), 10)
    place = F.row_number().over(W.orderBy(F.desc("anomaly_score"), "source", "line_number"))
    return rounded(top.withColumn("is_recent_alert", place <= 5), "anomaly_score")


@query("first_anomalies", sql(f", t AS (SELECT * FROM logs WHERE is_anomaly = 1 ORDER BY line_number, source LIMIT 50) SELECT {_SHOWN} FROM t"))
def first_anomalies(spark, sf_dir):
    return rounded(R.first_rows(views.scored_logs(spark, sf_dir), 50, anomalies_only=True), "anomaly_score")


@query("first_rows", sql(f", t AS (SELECT * FROM logs ORDER BY line_number, source LIMIT 100) SELECT {_SHOWN} FROM t"))
def first_rows(spark, sf_dir):
    return rounded(R.first_rows(views.scored_logs(spark, sf_dir), 100), "anomaly_score")


@query("anomalies_only", sql(f"SELECT {_SHOWN} FROM logs WHERE is_anomaly = 1"))
def anomalies_only(spark, sf_dir):
    return rounded(views.scored_logs(spark, sf_dir).where(R.flagged()), "anomaly_score")


_RUNS = """SELECT event_type, day(ts) <= 15 AS base, avg(value) AS time, max(value) AS memory FROM events GROUP BY ALL"""


@query(
    "benchmark_diff",
    f"""WITH r AS ({_RUNS}),
j AS (SELECT b.event_type, b.time AS bt, b.memory AS bm, c.time AS ct, c.memory AS cm FROM r b JOIN r c ON b.event_type = c.event_type AND b.base AND NOT c.base),
d AS (SELECT *, 100 * (ct - bt) / bt AS tc, 100 * (cm - bm) / bm AS mc FROM j)
SELECT event_type, round(bt, 6) AS baseline_time, round(bm, 6) AS baseline_memory, round(ct, 6) AS current_time, round(cm, 6) AS current_memory,
  round(tc, 6) AS time_change, round(mc, 6) AS memory_change,
  CASE WHEN tc > 10 OR mc > 20 THEN 'regression' WHEN tc < -5 OR mc < -10 THEN 'improvement' ELSE 'unchanged' END AS verdict FROM d""",
)
def benchmark_diff(spark, sf_dir):
    """Mean and largest value per event type: first half of the month against the second."""
    events = views.table(spark, sf_dir, "events")
    runs = events.groupBy("event_type", (F.dayofmonth("ts") <= 15).alias("base")).agg(
        F.avg("value").alias("time"), F.max("value").alias("memory")
    )
    diff = R.benchmark_diff(runs.where("base"), runs.where("NOT base"), ["event_type"])
    return rounded(diff, "baseline_time", "baseline_memory", "current_time", "current_memory", "time_change", "memory_change")


@query(
    "scaling_fit",
    """WITH r AS (SELECT event_type, day(ts) AS d, count(*)::DOUBLE AS size, sum(value) AS time FROM events GROUP BY ALL),
o AS (SELECT *, size / lag(size) OVER w AS sr, time / lag(time) OVER w AS tr FROM r WINDOW w AS (PARTITION BY event_type ORDER BY size, time)),
s AS (SELECT event_type, regr_slope(time, size) AS slope, avg(sr) AS s, avg(tr) AS t, avg(size / time) AS p FROM o GROUP BY 1)
SELECT event_type, round(slope, 4) AS slope, round(p, 6) AS throughput,
  CASE WHEN t IS NULL THEN 'insufficient_data' WHEN t <= s * 1.2 THEN 'O(n) - Linear' WHEN t <= pow(s, 1.5) * 1.2 THEN 'O(n log n) - Linearithmic' WHEN t <= s * s * 1.2 THEN 'O(n²) - Quadratic' ELSE 'O(n³+) - Polynomial or worse' END AS growth,
  CASE WHEN p > 100000 THEN 'excellent' WHEN p > 50000 THEN 'very_good' WHEN p > 10000 THEN 'good' WHEN p > 1000 THEN 'fair' ELSE 'poor' END AS rating FROM s""",
)
def scaling_fit(spark, sf_dir):
    """One run per event type and day: number of events against summed value."""
    events = views.table(spark, sf_dir, "events")
    runs = events.groupBy("event_type", F.dayofmonth("ts").alias("d")).agg(
        F.count(F.lit(1)).cast("double").alias("size"), F.sum("value").alias("time")
    )
    return rounded(rounded(R.scaling_fit(runs, ["event_type"]), "slope", digits=4), "throughput")

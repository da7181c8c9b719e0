"""Alerts, service levels, metric status and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.config import AlertConfig
from logharbor.functions.ordering import hour_start
from logharbor.operators import alerts as A
from logharbor.operators import service as S
from logharbor.plans import views
from logharbor.plans.feature_queries import rounded
from logharbor.plans.registry import query

_SEVERITY = """CASE WHEN upper(level) = 'ERROR' OR logs.anomaly_score > 0.9 THEN 'CRITICAL'
  WHEN upper(level) = 'WARNING' OR logs.anomaly_score > 0.7 THEN 'WARNING' ELSE 'INFO' END"""

_ALERTS = f""", s AS (SELECT *, {_SEVERITY} AS severity, lower(message) AS m FROM logs WHERE is_anomaly = 1),
al AS (SELECT *, concat(severity, ': ', CASE WHEN contains(m, 'error') THEN 'Error Detected in ' || level || ' Log' WHEN contains(m, 'exception') THEN 'Exception Detected'
    WHEN contains(m, 'fail') THEN 'Failure Detected' ELSE 'Anomalous ' || level || ' Log Detected' END) AS title,
  concat_ws(',', 'logharbor', 'anomaly', 'level:' || lower(level), CASE WHEN contains(m, 'database') THEN 'database' END, CASE WHEN contains(m, 'network') THEN 'network' END,
    CASE WHEN contains(m, 'auth') OR contains(m, 'login') THEN 'authentication' END, CASE WHEN contains(m, 'performance') THEN 'performance' END) AS tags,
  CASE severity WHEN 'CRITICAL' THEN '{",".join(K.ALERT_ACTIONS["CRITICAL"])}' WHEN 'WARNING' THEN '{",".join(K.ALERT_ACTIONS["WARNING"])}' ELSE '{",".join(K.ALERT_ACTIONS["INFO"])}' END AS actions
FROM s)
"""


@query(
    "alerts",
    views.with_views(
        "logs",
        _ALERTS + """SELECT md5(message) AS id, source, line_number, timestamp, severity, title, substring(message, 1, 500) AS description,
  round(al.anomaly_score, 6) AS anomaly_score, level AS log_level, 'logharbor' AS origin, tags, actions FROM al""",
    ),
)
def alerts(spark, sf_dir):
    rows = rounded(A.alerts(views.scored_logs(spark, sf_dir)), "anomaly_score")
    return rows.withColumn("tags", F.array_join("tags", ",")).withColumn("actions", F.array_join("actions", ","))


@query(
    "alert_summary",
    views.with_views(
        "logs",
        _ALERTS + """, t AS (SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM al) GROUP BY tag ORDER BY n DESC, tag LIMIT 5)
SELECT count(*) AS total_alerts, count(*) FILTER (severity = 'CRITICAL') AS critical_alerts, count(*) FILTER (severity = 'WARNING') AS warning_alerts,
  count(*) FILTER (severity = 'INFO') AS info_alerts, min(timestamp) AS first_alert, max(timestamp) AS last_alert,
  (SELECT string_agg(tag, ',' ORDER BY n DESC, tag) FROM t) AS most_common_tags FROM al""",
    ),
)
def alert_summary(spark, sf_dir):
    summary = A.alert_summary(A.alerts(views.scored_logs(spark, sf_dir)))
    return summary.withColumn("most_common_tags", F.array_join("most_common_tags", ","))


@query(
    "notification_payload",
    views.with_views(
        "logs",
        """, s AS (SELECT count(*) AS total_logs, count(*) FILTER (is_anomaly = 1) AS anomalies, 100.0 * count(*) FILTER (is_anomaly = 1) / count(*) AS r, max(timestamp) AS t FROM logs)
SELECT total_logs, anomalies, round(r, 6) AS anomaly_rate, strftime(t, '%Y-%m-%d %H:%M') AS generated,
  CASE WHEN r > 10 THEN 'HIGH ANOMALY RATE DETECTED - Immediate investigation recommended' WHEN r > 5 THEN 'ELEVATED ANOMALY RATE - Monitor closely' END AS warning,
  CASE WHEN r > 10 THEN 'HIGH' WHEN r > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  concat('{"blocks":["Log analysis report","*Total Logs:* ', format('{:,}', total_logs), '","*Anomalies:* ', format('{:,}', anomalies), '","*Anomaly Rate:* ', format('{:.2f}', r), '%","*Generated:* ',
    strftime(t, '%Y-%m-%d %H:%M'), '"', CASE WHEN r > 10 THEN ',"HIGH ANOMALY RATE DETECTED - Immediate investigation recommended"' WHEN r > 5 THEN ',"ELEVATED ANOMALY RATE - Monitor closely"' ELSE '' END, ']}') AS payload FROM s""",
    ),
)
def notification_payload(spark, sf_dir):
    logs = views.scored_logs(spark, sf_dir)
    now = logs.agg(F.max("timestamp")).scalar()
    return rounded(A.notification(logs, now), "anomaly_rate")


_WINDOWS = """, h AS (SELECT source, time_bucket(INTERVAL 6 HOUR, timestamp) AS window_start, line_number, message,
  row_number() OVER (PARTITION BY source, time_bucket(INTERVAL 6 HOUR, timestamp) ORDER BY line_number) AS r FROM logs WHERE is_anomaly = 1),
w AS (SELECT source, window_start::TIMESTAMP AS window_start, count(*) AS count, string_agg(message, '|' ORDER BY line_number) FILTER (r <= 5) AS sample_messages
  FROM h GROUP BY source, window_start HAVING count(*) >= 2)
"""
_WIDE = AlertConfig(anomaly_threshold=2, time_window_minutes=360, throttle_minutes=900)


@query("alert_windows", views.with_views("logs", _WINDOWS + "SELECT source, window_start, count, sample_messages FROM w"))
def alert_windows(spark, sf_dir):
    """Windows of six hours: the log has one line every few minutes."""
    rows = A.alert_windows(views.scored_logs(spark, sf_dir), _WIDE)
    return rows.withColumn("sample_messages", F.array_join("sample_messages", "|"))


@query(
    "alert_throttle",
    views.with_views(
        "logs",
        _WINDOWS + """, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY window_start) AS i FROM w),
f(source, i, window_start, last_sent, sent) AS (
  SELECT source, i, window_start, window_start, TRUE FROM o WHERE i = 1
  UNION ALL SELECT o.source, o.i, o.window_start, CASE WHEN o.window_start >= f.last_sent + INTERVAL 900 MINUTE THEN o.window_start ELSE f.last_sent END,
    o.window_start >= f.last_sent + INTERVAL 900 MINUTE FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
SELECT f.source, f.window_start, w.count FROM f JOIN w ON w.source = f.source AND w.window_start = f.window_start WHERE sent""",
        recursive=True,
    ),
)
def alert_throttle(spark, sf_dir):
    windows = A.alert_windows(views.scored_logs(spark, sf_dir), _WIDE)
    return A.throttled(windows, _WIDE).select("source", "window_start", "count")


@query(
    "sla_hourly",
    views.with_views("requests", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS requests, count(*) FILTER (NOT success) AS errors FROM requests GROUP BY 1"),
)
def sla_hourly(spark, sf_dir):
    return S.hourly_requests(views.requests(spark, sf_dir))


@query(
    "sla_metrics",
    views.with_views(
        "requests",
        """, a AS (SELECT max(ts) AS t FROM requests), h AS (SELECT count(*) AS n, count(*) FILTER (NOT success) AS e FROM requests, a WHERE date_trunc('hour', ts) >= t - INTERVAL 24 HOUR),
r AS (SELECT list_sort(list(response_time)) AS v, avg(response_time) AS m FROM requests, a WHERE ts BETWEEN t - INTERVAL 24 HOUR AND t),
x AS (SELECT 100.0 * (n - e) / n AS availability, 100.0 * e / n AS error_rate, v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95,
  v[CAST(floor(len(v) * 0.99) AS BIGINT) + 1] AS p99, m FROM h, r)
SELECT round(availability, 6) AS availability, round(error_rate, 6) AS error_rate, p50 AS response_time_p50, p95 AS response_time_p95, p99 AS response_time_p99, round(m, 6) AS response_time_avg,
  availability >= 99.9 AS availability_ok, p95 <= 5.0 AS response_time_ok, error_rate <= 0.1 AS error_rate_ok FROM x""",
    ),
)
def sla_metrics(spark, sf_dir):
    requests = views.requests(spark, sf_dir)
    metrics = S.sla_metrics(requests, requests.agg(F.max("ts")).scalar())
    return rounded(metrics, "availability", "error_rate", "response_time_avg")


_METRICS = """SELECT date_trunc('hour', ts)::{T} AS time, CASE user_id % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'cpu' ELSE 'disk' END AS metric,
  max(value) / 5 AS value FROM {E} GROUP BY ALL"""


@query(
    "metric_status",
    f"""WITH m AS ({_METRICS.replace('{T}', 'TIMESTAMP').replace('{E}', 'events')}),
k AS (SELECT *, CASE WHEN value > CASE metric WHEN 'memory' THEN 90 ELSE 95 END THEN 2 WHEN value > CASE metric WHEN 'memory' THEN 80 ELSE 85 END THEN 1 ELSE 0 END AS r FROM m)
SELECT time, metric, round(value, 6) AS value, ['healthy','degraded','unhealthy'][r + 1] AS status, ['healthy','degraded','unhealthy'][max(r) OVER (PARTITION BY time) + 1] AS overall FROM k""",
)
def metric_status(spark, sf_dir):
    """A fifth of the largest value per hour, taken as a percentage, for three metrics."""
    events = views.table(spark, sf_dir, "events")
    metric = F.when(F.col("user_id") % 3 == 0, "memory").when(F.col("user_id") % 3 == 1, "cpu").otherwise("disk")
    metrics = events.groupBy(
        hour_start(F.col("ts")).alias("time"), metric.alias("metric")
    ).agg((F.max("value") / 5).alias("value"))
    return rounded(S.metric_status(metrics), "value")


@query(
    "rate_limit",
    views.with_views(
        "requests",
        """, o AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts, request_id) AS i FROM requests),
f(client_id, i, request_id, kept, allowed) AS (
  SELECT client_id, i, request_id, [ts], TRUE FROM o WHERE i = 1
  UNION ALL
  SELECT o.client_id, o.i, o.request_id,
    CASE WHEN len(list_filter(f.kept, lambda x: x > o.ts - INTERVAL 6 HOUR)) < 4 THEN list_append(list_filter(f.kept, lambda x: x > o.ts - INTERVAL 6 HOUR), o.ts)
         ELSE list_filter(f.kept, lambda x: x > o.ts - INTERVAL 6 HOUR) END,
    len(list_filter(f.kept, lambda x: x > o.ts - INTERVAL 6 HOUR)) < 4
  FROM f JOIN o ON o.client_id = f.client_id AND o.i = f.i + 1)
SELECT request_id, client_id, allowed FROM f""",
        recursive=True,
    ),
)
def rate_limit(spark, sf_dir):
    """Four requests in six hours per client, so that the limit is met and refused."""
    rows = S.rate_limit(views.requests(spark, sf_dir), max_requests=4, window_seconds=6 * 3600)
    return rows.select("request_id", "client_id", "allowed")

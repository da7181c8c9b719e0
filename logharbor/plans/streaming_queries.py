"""The streaming jobs, drained over the whole events table and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.config import AlertConfig
from logharbor.operators.features import with_basic_features
from logharbor.operators.isolation_forest import IsolationForest
from logharbor.operators.statistical import detect_long_messages
from logharbor.plans import views
from logharbor.plans.feature_queries import rounded
from logharbor.plans.registry import query
from logharbor.session import shared_dir
from logharbor.streaming import monitor as M
from logharbor.streaming.live_alerts import Flush, drain_and_flush, live_alerts
from logharbor.streaming.newest import NewestRows, newest_rows
from logharbor.streaming.outbox import Outbox
from logharbor.streaming.service_levels import hourly_value_counts, rolling_levels

_WIDE = AlertConfig(anomaly_threshold=2, time_window_minutes=360, throttle_minutes=900)


def _drain(stream, write, mode="append"):
    spark = stream.sparkSession
    M.start(stream, write, shared_dir(spark, "progress"), mode=mode).awaitTermination()


def _ntz(column):
    return F.col(column).cast("timestamp_ntz").alias(column)


@query(
    "stream_alert_windows",
    views.with_views("logs", """SELECT source, time_bucket(INTERVAL 6 HOUR, timestamp)::TIMESTAMP AS window_start, count(*) AS count
FROM logs WHERE is_anomaly = 1 GROUP BY ALL HAVING count(*) >= 2"""),
)
def stream_alert_windows(spark, sf_dir):
    folder = shared_dir(spark, "alert-windows")
    alerts = M.windowed_alerts(views.scored_log_stream(spark, sf_dir), _WIDE)
    _drain(alerts, M.upserting_batches(folder), mode="update")
    found = M.latest_update(spark, folder, ["source", "window_start"])
    return found.select("source", _ntz("window_start"), "count")


@query(
    "stream_alert_throttle",
    views.with_views(
        "logs",
        """, c AS (SELECT source, time_bucket(INTERVAL 6 HOUR, timestamp)::TIMESTAMP AS window_start, count(*) AS count,
  array_to_string(list_slice(list(coalesce(message, '') ORDER BY timestamp, line_number), 1, 5), ' | ') AS messages FROM logs WHERE is_anomaly = 1 AND timestamp IS NOT NULL GROUP BY ALL),
w AS (SELECT * FROM c WHERE count >= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY window_start) AS i FROM w),
f(source, i, window_start, last_sent, sent) AS (
  SELECT source, i, window_start, window_start, TRUE FROM o WHERE i = 1
  UNION ALL SELECT o.source, o.i, o.window_start, CASE WHEN o.window_start >= f.last_sent + INTERVAL 900 MINUTE THEN o.window_start ELSE f.last_sent END,
    o.window_start >= f.last_sent + INTERVAL 900 MINUTE FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
SELECT f.source, f.window_start, w.count, w.messages FROM f JOIN w ON w.source = f.source AND w.window_start = f.window_start WHERE sent""",
        recursive=True,
    ),
)
def stream_alert_throttle(spark, sf_dir):
    """Every alert of the stream with its first messages, those of the last windows included, delivered through an outbox."""
    sent = shared_dir(spark, "sent")
    outbox = Outbox(shared_dir(spark, "outbox"), lambda rows: rows.drop("delivery_key").write.mode("append").parquet(sent))
    flush, progress = Flush(spark), shared_dir(spark, "progress")
    start = lambda: M.start(live_alerts(views.scored_log_stream(spark, sf_dir), _WIDE, control=flush.stream()), outbox.put, progress)
    drain_and_flush(start, flush, _WIDE)
    schema = "source string, window_start timestamp, count bigint, messages array<string>"
    spark.createDataFrame([], schema).write.mode("append").parquet(sent)
    rows = spark.read.schema(schema).parquet(sent)
    return rows.select("source", _ntz("window_start"), "count", F.array_join("messages", " | ").alias("messages"))


@query(
    "stream_scores",
    views.with_views("app_logs", """, s AS (SELECT avg(length(message)) AS m, stddev_samp(length(message)) AS sd FROM app_logs)
SELECT source, line_number, round(abs(length(message) - m) / sd, 6) AS anomaly_score, CAST(abs(length(message) - m) / sd > 2.0 AS INT) AS is_anomaly FROM app_logs, s"""),
)
def stream_scores(spark, sf_dir):
    """A detector fitted per micro-batch; the table arrives as one micro-batch."""
    folder = shared_dir(spark, "scores")
    _drain(views.scored_log_stream(spark, sf_dir), M.scoring_batches(detect_long_messages, folder))
    rows = spark.read.parquet(folder).select("source", "line_number", "anomaly_score", "is_anomaly")
    return rounded(rows, "anomaly_score")


def _log_files(spark, sf_dir, files):
    """The log as a stream of several files in order of time, one in each micro-batch."""
    folder = shared_dir(spark, "log-files")
    logs = views.app_logs(spark, sf_dir)
    logs.repartitionByRange(files, "timestamp", "line_number").write.parquet(folder)
    return spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(folder)


_NEWEST = """SELECT source, line_number, level, message FROM app_logs
QUALIFY row_number() OVER (PARTITION BY source, level ORDER BY timestamp DESC NULLS LAST, line_number DESC) <= 5"""


@query("newest_rows", views.with_views("app_logs", _NEWEST))
def newest(spark, sf_dir):
    """The five newest rows of each source and level."""
    return newest_rows(views.app_logs(spark, sf_dir), ["source", "level"], 5).select("source", "line_number", "level", "message")


@query("stream_newest_rows", views.with_views("app_logs", _NEWEST))
def stream_newest(spark, sf_dir):
    """The same, kept up to date over four micro-batches."""
    keep = NewestRows(shared_dir(spark, "newest"), ["source", "level"], 5)
    _drain(_log_files(spark, sf_dir, 4), keep)
    return keep.rows(spark).select("source", "line_number", "level", "message")


@query(
    "stream_refit_batches",
    "SELECT count(*) AS rows, count(DISTINCT event_id) AS different, 4 AS batches, 1 AS unscored FROM events",
)
def stream_refit_batches(spark, sf_dir):
    """Every row once, in four micro-batches, of which only the first has no model yet."""
    rows = stream_refit(spark, sf_dir, "batch")
    scored = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("anomaly_score")).alias("top"))
    distinct = rows.agg(F.count_distinct("line_number").alias("d")).scalar()
    return scored.agg(
        F.sum("n").alias("rows"), distinct.alias("different"),
        F.count(F.lit(1)).cast("int").alias("batches"), F.count_if(F.col("top") == 0).cast("int").alias("unscored"),
    )


@query("stream_refit")
def stream_refit(spark, sf_dir, *more):
    """An isolation forest refitted on the latest 100 rows after each of four micro-batches."""
    names = ["message_length", "word_count", "severity_score", "hour"]
    learner = M.LatestRowsModel(
        lambda rows: IsolationForest(names, contamination=0.1).fit(rows), shared_dir(spark, "latest")
    )
    folder = shared_dir(spark, "refit")
    _drain(with_basic_features(_log_files(spark, sf_dir, 4)), learner.batches(folder))
    rows = spark.read.parquet(folder).select("source", "line_number", "is_anomaly", "anomaly_score", *more)
    return rounded(rows, "anomaly_score")


@query(
    "stream_rate_limit",
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
def stream_rate_limit(spark, sf_dir):
    folder = shared_dir(spark, "limited")
    decide = M.RateLimitBatches(folder, shared_dir(spark, "limit-state"), 4, 6 * 3600)
    _drain(views.request_stream(spark, sf_dir), decide)
    return spark.read.parquet(folder).select("request_id", "client_id", "allowed")


@query(
    "stream_sla",
    views.with_views("requests", """, h AS (SELECT unnest([date_trunc('hour', ts) - INTERVAL 1 HOUR * i for i in range(24)]) AS s, * FROM requests),
g AS (SELECT s, count(*) AS requests, count(*) FILTER (NOT success) AS errors, list_sort(list(response_time) FILTER (response_time IS NOT NULL)) AS v, CAST(sum(CAST(response_time AS DECIMAL(24,9))) AS DOUBLE) / count(response_time) AS m FROM h GROUP BY s),
x AS (SELECT *, 100.0 * (requests - errors) / requests AS availability, 100.0 * errors / requests AS error_rate,
  v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(len(v) * 0.99) AS BIGINT) + 1] AS p99 FROM g)
SELECT s::TIMESTAMP AS window_start, (s + INTERVAL 24 HOUR)::TIMESTAMP AS window_end, requests, errors,
  round(availability, 6) AS availability, round(error_rate, 6) AS error_rate, p50 AS response_time_p50, p95 AS response_time_p95, p99 AS response_time_p99, round(m, 6) AS response_time_avg,
  availability >= 99.9 AS availability_ok, p95 <= 5.0 AS response_time_ok, error_rate <= 0.1 AS error_rate_ok FROM x"""),
)
def stream_sla(spark, sf_dir):
    """Trailing 24 hours, every hour, from the hourly counts of response times a stream keeps up to date."""
    folder = shared_dir(spark, "value-counts")
    counts = hourly_value_counts(views.request_stream(spark, sf_dir))
    _drain(counts, M.upserting_batches(folder), mode="update")
    rows = rolling_levels(M.latest_update(spark, folder, ["hour", "response_time"]))
    rows = rows.withColumn("window_start", _ntz("window_start")).withColumn("window_end", _ntz("window_end"))
    return rounded(rows, "availability", "error_rate", "response_time_avg")

"""Log-shaped views over the given tables, for Spark and, as SQL text, for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_APP_LOGS = """
SELECT event_id + 1 AS line_number, ts AS timestamp,
  CASE WHEN event_type='error' AND value > 150 THEN 'CRITICAL' WHEN event_type='error' THEN 'ERROR'
       WHEN event_type='purchase' THEN 'WARN' WHEN event_type='signup' THEN 'WARNING'
       WHEN event_type='view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  concat(CASE WHEN event_type='error' AND event_id % 3 = 0 THEN 'Exception: database timeout'
              WHEN event_type='error' AND event_id % 3 = 1 THEN 'Failed login attempt, access denied'
              WHEN event_type='error' THEN 'Critical network error'
              WHEN event_type='purchase' THEN 'Warning: high memory usage detected'
              WHEN event_type='signup' THEN 'Start session init'
              WHEN event_type='view' THEN 'Request complete'
              ELSE 'User action processed' END,
         ' for user ', CAST(user_id AS {S}), ' in ', CAST(CAST(floor(value) AS BIGINT) AS {S}), ' ms',
         CASE WHEN event_id % 50 = 0 THEN concat(' from 10.0.0.', CAST(event_id % 256 AS {S})) ELSE '' END,
         CASE WHEN event_id % 70 = 0 THEN ' see https://status.example.com/x' ELSE '' END,
         CASE WHEN event_id % 90 = 0 THEN concat(' contact ops', CAST(user_id AS {S}), '@example.com') ELSE '' END) AS message,
  concat('host', CAST(user_id % 8 AS {S})) AS source{extra}
FROM events
"""

_SCORES = """,
  CAST(CASE WHEN event_type='error' AND value > 100 THEN 1 ELSE 0 END AS INT) AS is_anomaly,
  CAST(CASE WHEN value / 300 > 1 THEN 1 ELSE value / 300 END AS DOUBLE) AS anomaly_score"""

_RAW_LINES = """
SELECT line_number, source, CASE WHEN line_number % 17 = 0 THEN message
  WHEN line_number % 5 = 0 THEN concat({F2}, ' ', level, ' ', message)
  ELSE concat({F1}, ' ', level, ' ', message) END AS line FROM app_logs
"""

_REQUESTS = """
SELECT event_id AS request_id, ts, concat('client', CAST(user_id % 20 AS {S})) AS client_id,
  value AS response_time, event_type <> 'error' AS success FROM events
"""

_ACCESS_LINES = """
SELECT event_id + 1 AS line_number, concat('web', CAST(user_id % 4 AS {S})) AS source,
  concat('10.0.', CAST(user_id % 4 AS {S}), '.', CAST(user_id % 256 AS {S}), ' - - [', {F3}, ' +0000] "',
         CASE WHEN event_type='purchase' THEN 'POST' ELSE 'GET' END, ' /', event_type, '/', CAST(event_id % 10 AS {S}), ' HTTP/1.1" ',
         CASE WHEN event_type='error' AND value > 50 THEN '500' WHEN event_type='error' THEN '404' ELSE '200' END, ' ',
         CASE WHEN event_id % 11 = 0 THEN '-' ELSE CAST(CAST(floor(value * 10) AS BIGINT) AS {S}) END,
         ' "-" "agent/', CAST(user_id % 3 AS {S}), '"') AS line
FROM events
"""

_VOTES = """
SELECT event_id + 1 AS line_number, CAST(value AS DOUBLE) AS score_a, CAST(event_id % 97 AS DOUBLE) AS score_b,
  CAST(user_id AS DOUBLE) AS score_c, CAST(CASE WHEN value > 120 THEN 1 ELSE 0 END AS INT) AS vote_a,
  CAST(CASE WHEN value > 150 THEN 1 ELSE 0 END AS INT) AS vote_b,
  CAST(CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS INT) AS vote_c
FROM events
"""

_SPARK = {
    "S": "STRING",
    "F1": "date_format(timestamp,'yyyy-MM-dd HH:mm:ss')",
    "F2": "date_format(timestamp,'yyyy/MM/dd HH:mm:ss')",
    "F3": "date_format(ts,'dd/MMM/yyyy:HH:mm:ss')",
}
_DUCK = {
    "S": "VARCHAR",
    "F1": "strftime(timestamp,'%Y-%m-%d %H:%M:%S')",
    "F2": "strftime(timestamp,'%Y/%m/%d %H:%M:%S')",
    "F3": "strftime(ts,'%d/%b/%Y:%H:%M:%S')",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table. One that comes in fewer splits than there are cores (a single row
    group, say) is spread by rows, or all later work on it would run in one task; a table
    of many splits is read as it is, without a shuffle."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def _view(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(text.replace("FROM events", "FROM {events}").replace("FROM app_logs", "FROM {app_logs}"), **frames)


def _render(template: str, dialect: dict[str, str], extra: str = "") -> str:
    text = template
    for key, value in {**dialect, "extra": extra}.items():
        text = text.replace("{" + key + "}", value)
    return text


def app_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, _render(_APP_LOGS, _SPARK), events=table(spark, sf_dir, "events"))


def scored_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, _render(_APP_LOGS, _SPARK, _SCORES), events=table(spark, sf_dir, "events"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, _render(_RAW_LINES, _SPARK), app_logs=app_logs(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, _render(_REQUESTS, _SPARK), events=table(spark, sf_dir, "events"))


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, _render(_ACCESS_LINES, _SPARK), events=table(spark, sf_dir, "events"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, _render(_VOTES, _SPARK), events=table(spark, sf_dir, "events"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern matches the table as a single file and as a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque?")


def scored_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, _render(_APP_LOGS, _SPARK, _SCORES), events=_event_stream(spark, sf_dir))


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, _render(_REQUESTS, _SPARK), events=_event_stream(spark, sf_dir))


_SQL = {
    "app_logs": _render(_APP_LOGS, _DUCK),
    "logs": _render(_APP_LOGS, _DUCK, _SCORES),
    "raw_lines": _render(_RAW_LINES, _DUCK),
    "requests": _render(_REQUESTS, _DUCK),
    "access_lines": _render(_ACCESS_LINES, _DUCK),
    "votes": _render(_VOTES, _DUCK),
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """A DuckDB statement with the named views in front; ``body`` may go on with ``, x AS (…)``."""
    needed = names.split()
    if "raw_lines" in needed and "app_logs" not in needed:
        needed.insert(0, "app_logs")
    heads = ", ".join(f"{n} AS ({_SQL[n]})" for n in needed)
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    return f"{keyword} {heads} {body}"

"""Queries on raw lines and message text."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import text as X
from logharbor.operators import parsing
from logharbor.operators.report import hourly_timeline
from logharbor.operators.statistical import detect_statistical
from logharbor.plans import views
from logharbor.plans.registry import query

_P1 = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (ERROR|WARN|INFO|DEBUG) (.+)"
_P2 = r"(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) (\w+) (.+)"

PARSED_CTE = rf""", parsed AS (
  SELECT line_number, source,
    CASE WHEN regexp_matches(line, '{_P1}') THEN regexp_extract(line, '{_P1}', 1)
         WHEN regexp_matches(line, '{_P2}') THEN regexp_extract(line, '{_P2}', 1) END AS timestamp_raw,
    CASE WHEN regexp_matches(line, '{_P1}') THEN regexp_extract(line, '{_P1}', 2)
         WHEN regexp_matches(line, '{_P2}') THEN regexp_extract(line, '{_P2}', 2) ELSE 'UNPARSED' END AS level,
    CASE WHEN regexp_matches(line, '{_P1}') THEN regexp_extract(line, '{_P1}', 3)
         WHEN regexp_matches(line, '{_P2}') THEN regexp_extract(line, '{_P2}', 3) ELSE line END AS message
  FROM (SELECT line_number, source, trim(line) AS line FROM raw_lines) WHERE line <> ''),
logs AS (SELECT *, TRY_CAST(replace(timestamp_raw, '/', '-') AS TIMESTAMP) AS timestamp FROM parsed)
"""

STATISTICAL_CTE = r""", feats AS (
  SELECT *, length(message) AS f1,
    CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2 WHEN 'ERROR' THEN 3 ELSE 1 END AS f2,
    coalesce(hour(timestamp), 0) AS f3, coalesce(minute(timestamp), 0) AS f4,
    len(regexp_extract_all(message, '\S+')) AS f5
  FROM logs),
st AS (SELECT """ + ", ".join(
    f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}, quantile_cont(f{i}::DOUBLE, 0.25) AS a{i}, quantile_cont(f{i}::DOUBLE, 0.75) AS b{i}"
    for i in range(1, 6)
) + """ FROM feats),
zi AS (SELECT feats.*,
  least(greatest(0.0::DOUBLE, """ + ", ".join(
    f"coalesce(abs(f{i} - m{i}) / nullif(s{i}, 0), 0)" for i in range(1, 6)
) + """) / 3.0::DOUBLE, 1.0::DOUBLE) AS z_score,
  least(greatest(0.0::DOUBLE, """ + ", ".join(
    f"coalesce((a{i} - 1.5::DOUBLE*(b{i}-a{i}) - f{i}) / nullif(b{i}-a{i}, 0), 0), coalesce((f{i} - b{i} - 1.5::DOUBLE*(b{i}-a{i})) / nullif(b{i}-a{i}, 0), 0)"
    for i in range(1, 6)
) + """), 1.0::DOUBLE) AS iqr_score FROM feats, st),
detected AS (SELECT *, greatest(z_score, iqr_score) AS anomaly_score,
  CAST(CASE WHEN greatest(z_score, iqr_score) > 0.5 THEN 1 ELSE 0 END AS INT) AS is_anomaly FROM zi)
"""


@query(
    "anomalies_per_hour",
    views.with_views(
        "raw_lines",
        PARSED_CTE + STATISTICAL_CTE + """
SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, CAST(sum(is_anomaly) AS BIGINT) AS anomalies,
  count(*) AS total FROM detected WHERE timestamp IS NOT NULL GROUP BY 1""",
    ),
)
def anomalies_per_hour(spark, sf_dir):
    """Raw lines → typed rows → statistical detector → hourly counts."""
    logs = parsing.LogParser().parse(views.raw_lines(spark, sf_dir))
    return hourly_timeline(detect_statistical(logs))


@query(
    "parse_lines",
    views.with_views(
        "raw_lines",
        PARSED_CTE + "SELECT line_number, source, timestamp_raw, level, message, timestamp FROM logs",
    ),
)
def parse_lines(spark, sf_dir):
    return parsing.LogParser().parse(views.raw_lines(spark, sf_dir))


_ACCESS = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\d+|-) "([^"]*)" "([^"]*)"'


@query(
    "parse_access_log",
    views.with_views(
        "access_lines",
        rf""", g AS (SELECT line_number, source, regexp_extract(line, '{_ACCESS}',
  ['ip','ts','method','url','protocol','status','size','referrer','agent']) AS m
  FROM access_lines WHERE regexp_matches(line, '{_ACCESS}'))
SELECT line_number, source, m.ip AS ip_address, m.method AS http_method, m.url AS url, m.referrer AS referrer,
  m.agent AS user_agent, CAST(m.status AS INT) AS status_code,
  coalesce(TRY_CAST(m.size AS BIGINT), 0) AS response_size,
  CAST(strptime(regexp_replace(m.ts, ' \+0000$', ''), '%d/%b/%Y:%H:%M:%S') AS TIMESTAMP) AS timestamp,
  CASE WHEN CAST(m.status AS INT) >= 500 THEN 'ERROR' WHEN CAST(m.status AS INT) >= 400 THEN 'WARNING' ELSE 'INFO' END AS level,
  concat(m.method, ' ', m.url, ' - ', m.status) AS message
FROM g""",
    ),
)
def parse_access_log(spark, sf_dir):
    return parsing.parse_access_log(views.access_lines(spark, sf_dir))


_RATES = rf""", ranked AS (SELECT source, line, row_number() OVER (PARTITION BY source ORDER BY line_number) AS r FROM raw_lines WHERE trim(line) <> ''),
rates AS (
SELECT source, 'dash_dates' AS pattern, count(*) AS lines_checked, count(*) FILTER (regexp_matches(line, '{_P1}')) AS lines_matched,
  avg(CASE WHEN regexp_matches(line, '{_P1}') THEN 1.0 ELSE 0.0 END) AS match_rate FROM ranked WHERE r <= 100 GROUP BY source
UNION ALL
SELECT source, 'slash_dates', count(*), count(*) FILTER (regexp_matches(line, '{_P2}')),
  avg(CASE WHEN regexp_matches(line, '{_P2}') THEN 1.0 ELSE 0.0 END) FROM ranked WHERE r <= 100 GROUP BY source)
"""
_SNIFFED = {"dash_dates": K.DEFAULT_PATTERNS[0], "slash_dates": K.DEFAULT_PATTERNS[1]}


@query(
    "parse_rate_by_pattern",
    views.with_views("raw_lines", _RATES + "SELECT source, pattern, lines_checked, lines_matched, round(match_rate, 6) AS match_rate FROM rates"),
)
def parse_rate_by_pattern(spark, sf_dir):
    rates = parsing.pattern_rates(views.raw_lines(spark, sf_dir), _SNIFFED)
    return rates.withColumn("match_rate", F.round("match_rate", 6))


@query(
    "sniff_formats",
    views.with_views(
        "raw_lines",
        _RATES + """SELECT source, max_by(pattern, match_rate) AS pattern, round(max(match_rate), 6) AS match_rate
FROM rates WHERE match_rate >= 0.5 GROUP BY source""",
    ),
)
def sniff_formats(spark, sf_dir):
    best = parsing.sniff_formats(views.raw_lines(spark, sf_dir), _SNIFFED)
    return best.withColumn("match_rate", F.round("match_rate", 6))


@query(
    "clean_messages",
    r"""WITH t AS (SELECT conv_id, turn, concat(text, chr(13), chr(10), role, chr(13), text, chr(7), chr(9), repeat(text, 30)) AS m FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(
  CASE WHEN length(m) > 10000 THEN concat(substring(m, 1, 10000), '...[TRUNCATED]') ELSE m END,
  '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n|\r', chr(10), 'g') AS message FROM t""",
)
def clean_messages(spark, sf_dir):
    """Conversation texts, prolonged and with control characters put in."""
    text = F.col("text")
    message = F.concat(
        text, F.lit("\r\n"), F.col("role"), F.lit("\r"), text, F.lit("\x07\t"), F.repeat(text, F.lit(30))
    )
    turns = views.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", X.sanitized(message).alias("message"))


@query(
    "field_validity",
    views.with_views(
        "raw_lines",
        PARSED_CTE + r""", c AS (SELECT count(*) AS n,
  count(*) FILTER (regexp_matches(timestamp_raw, '^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}$')) AS a,
  count(*) FILTER (regexp_matches(level, '^(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)$')) AS b,
  count(*) FILTER (regexp_matches(regexp_extract(message, 'from (\S+)', 1), '^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$')) AS d,
  count(*) FILTER (regexp_matches(message, '^[a-zA-Z0-9_\-\s]*$')) AS e FROM logs)
SELECT 'timestamp' AS rule, n AS rows_checked, a AS rows_valid FROM c UNION ALL SELECT 'level', n, b FROM c
UNION ALL SELECT 'ip_address', n, d FROM c UNION ALL SELECT 'message', n, e FROM c""",
    ),
)
def field_validity(spark, sf_dir):
    logs = parsing.LogParser().parse(views.raw_lines(spark, sf_dir))
    return parsing.validity_counts(
        logs,
        {
            "timestamp": ("timestamp", F.col("timestamp_raw")),
            "level": ("log_level", F.col("level")),
            "ip_address": ("ip_address", F.regexp_extract("message", r"from (\S+)", 1)),
            "message": ("alphanumeric", F.col("message")),
        },
    )


TEMPLATE_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(message),
  '\d{4}-\d{2}-\d{2}', '<DATE>', 'g'), '\d{2}:\d{2}:\d{2}', '<TIME>', 'g'), '\d+\.\d+\.\d+\.\d+', '<IP>', 'g'),
  '\b\d+\b', '<NUMBER>', 'g'), '[^\w\s<>]', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(
    "message_templates",
    views.with_views("app_logs", f"SELECT {TEMPLATE_SQL} AS template, count(*) AS n, min(line_number) AS first_line FROM app_logs GROUP BY 1"),
)
def message_templates(spark, sf_dir):
    logs = views.app_logs(spark, sf_dir)
    return logs.groupBy(X.template(F.col("message")).alias("template")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first_line")
    )


EVENT_TYPE_SQL = """CASE WHEN regexp_matches(lower(message), 'error|exception|fail') THEN 'ERROR_TYPE'
  WHEN regexp_matches(lower(message), 'warning|warn') THEN 'WARN_TYPE'
  WHEN regexp_matches(lower(message), 'start|begin|init') THEN 'START_TYPE'
  WHEN regexp_matches(lower(message), 'end|finish|complete') THEN 'END_TYPE' ELSE 'INFO_TYPE' END"""


@query(
    "event_types",
    views.with_views("app_logs", f"SELECT {EVENT_TYPE_SQL} AS event_type, level, count(*) AS n FROM app_logs GROUP BY 1, 2"),
)
def event_types(spark, sf_dir):
    logs = views.app_logs(spark, sf_dir)
    return logs.groupBy(X.event_type(F.col("message")).alias("event_type"), "level").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "parse_text_files",
    views.with_views("raw_lines", PARSED_CTE + "SELECT level, count(*) AS n, count(timestamp) AS timed FROM logs GROUP BY level"),
)
def parse_text_files(spark, sf_dir):
    """Lines written as text files, read back with line numbers and parsed."""
    from logharbor.session import shared_dir
    from logharbor.sources.text import read_log_lines

    folder = shared_dir(spark, "lines")
    views.raw_lines(spark, sf_dir).select("line").write.text(folder)
    logs = parsing.LogParser().parse(read_log_lines(spark, folder))
    return logs.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("timed"))


@query(
    "line_numbers",
    views.with_views("raw_lines", "SELECT count(*) AS total, count(DISTINCT line_number) AS different, true AS gapless FROM raw_lines"),
)
def line_numbers(spark, sf_dir):
    """Lines of files of any block layout are numbered 1 … n in each file."""
    from logharbor.session import shared_dir
    from logharbor.sources.text import read_log_lines

    folder = shared_dir(spark, "lines")
    views.raw_lines(spark, sf_dir).select("line").write.text(folder)
    files = read_log_lines(spark, folder).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("line_number").alias("d"), F.max("line_number").alias("m")
    )
    return files.agg(
        F.sum("n").alias("total"), F.sum("d").alias("different"),
        F.bool_and((F.col("n") == F.col("m")) & (F.col("n") == F.col("d"))).alias("gapless"),
    )

"""Queries on the feature columns of the structured log."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.functions.stats import fitted, profile, robust_scaled, standard_scaled
from logharbor.operators import features as E
from logharbor.operators import tfidf as T
from logharbor.plans import views
from logharbor.plans.parsing_queries import TEMPLATE_SQL
from logharbor.plans.registry import query

KEY = ["source", "line_number"]


def rounded(df, *columns, digits=6):
    for name in columns:
        df = df.withColumn(name, F.round(F.col(name), digits))
    return df


def sql(body: str, views_needed: str = "app_logs") -> str:
    return views.with_views(views_needed, body)


def _stop_list() -> str:
    from logharbor.stopwords import ENGLISH

    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH) + "]"


SEVERITY_CORE = """CASE upper(level) WHEN 'CRITICAL' THEN 5 WHEN 'ERROR' THEN 4 WHEN 'WARN' THEN 3
  WHEN 'WARNING' THEN 3 WHEN 'INFO' THEN 2 WHEN 'DEBUG' THEN 1 ELSE 0 END"""
WORDS = r"len(regexp_extract_all(message, '\S+'))"
DOW = "((dayofweek(timestamp) + 6) % 7)"


@query(
    "features_basic",
    sql(f"""SELECT source, line_number, length(message) AS message_length, {WORDS} AS word_count,
  CAST({SEVERITY_CORE} AS BIGINT) AS severity_score, hour(timestamp) AS hour, CAST({DOW} AS BIGINT) AS day_of_week FROM app_logs"""),
)
def features_basic(spark, sf_dir):
    rows = E.with_basic_features(views.app_logs(spark, sf_dir))
    return rows.select(*KEY, "message_length", "word_count", "severity_score", "hour", "day_of_week")


@query(
    "features_severity_maps",
    sql(f"""SELECT level, CAST({SEVERITY_CORE} AS BIGINT) AS core,
  CAST(CASE upper(level) WHEN 'CRITICAL' THEN 5 WHEN 'FATAL' THEN 5 WHEN 'ERROR' THEN 4 WHEN 'WARN' THEN 3 WHEN 'WARNING' THEN 3
    WHEN 'INFO' THEN 2 WHEN 'DEBUG' THEN 1 WHEN 'TRACE' THEN 1 ELSE 0 END AS BIGINT) AS extended,
  CAST(CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 1 END AS BIGINT) AS five_level,
  CAST(CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2 WHEN 'ERROR' THEN 3 ELSE 1 END AS BIGINT) AS four_level,
  CAST(CASE level WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2 WHEN 'WARN' THEN 3 WHEN 'ERROR' THEN 4 END AS BIGINT) AS csv,
  count(*) AS n FROM app_logs GROUP BY level"""),
)
def features_severity_maps(spark, sf_dir):
    from logharbor.constants import SEVERITY_MAPS
    from logharbor.functions.text import severity

    counts = views.app_logs(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("*", *[severity(F.col("level"), m).alias(m) for m in SEVERITY_MAPS])


@query(
    "features_cyclical",
    sql(f"""SELECT source, line_number, round(sin(2*pi()*hour(timestamp)/24), 6) AS hour_sin, round(cos(2*pi()*hour(timestamp)/24), 6) AS hour_cos,
  round(sin(2*pi()*{DOW}/7), 6) AS day_sin, round(cos(2*pi()*{DOW}/7), 6) AS day_cos FROM app_logs"""),
)
def features_cyclical(spark, sf_dir):
    names = ["hour_sin", "hour_cos", "day_sin", "day_cos"]
    rows = E.with_cyclical_features(views.app_logs(spark, sf_dir))
    return rounded(rows.select(*KEY, *names), *names)


@query(
    "features_flags",
    sql(r"""SELECT source, line_number,
  round(len(list_distinct(string_split(message, ''))) / length(message), 6) AS message_complexity,
  CAST(regexp_matches(message, '\d') AS INT) AS has_numbers,
  CAST(regexp_matches(message, '[!@#$%^&*()_+\-=\[\]{};:"\\|,.<>\?]') AS INT) AS has_special_chars,
  CAST(regexp_matches(message, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') AS INT) AS has_ip_address,
  CAST(regexp_matches(message, 'http[s]?://') AS INT) AS has_url,
  CAST(regexp_matches(message, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b') AS INT) AS has_email FROM app_logs"""),
)
def features_flags(spark, sf_dir):
    rows = E.with_flags(views.app_logs(spark, sf_dir))
    names = ["has_numbers", "has_special_chars", "has_ip_address", "has_url", "has_email"]
    return rounded(rows.select(*KEY, "message_complexity", *names), "message_complexity")


def _count_of(word: str, text: str = "t") -> str:
    return f"CAST((length({text}) - length(replace({text}, '{word}', ''))) / {len(word)} AS BIGINT)"


@query(
    "features_linguistic",
    sql(f""", p AS (SELECT source, line_number, {TEMPLATE_SQL} AS t FROM app_logs),
w AS (SELECT *, list_filter(string_split(t, ' '), lambda x: x <> '') AS ws FROM p)
SELECT source, line_number, len(ws) AS words, length(t) AS chars,
  round(len(list_distinct(ws)) / greatest(len(ws), 1), 6) AS lexical_diversity,
  round(len(list_filter(ws, lambda x: x = upper(x) AND x <> lower(x))) / greatest(len(ws), 1), 6) AS uppercase_ratio,
  {_count_of('<NUMBER>')} AS number_count, {_count_of('<IP>')} AS ip_count, {_count_of('<DATE>')} AS date_count, {_count_of('<TIME>')} AS time_count FROM w"""),
)
def features_linguistic(spark, sf_dir):
    rows = E.with_linguistic_features(views.app_logs(spark, sf_dir)).drop("timestamp", "level", "message")
    return rounded(rows, "lexical_diversity", "uppercase_ratio")


@query(
    "features_error_keywords",
    sql("SELECT source, line_number, " + ", ".join(
        f"CAST(contains(lower(message), '{k}') AS INT) AS has_{k}" for k in
        ("error", "fail", "exception", "critical", "timeout", "invalid", "denied", "refused", "abort", "crash")
    ) + " FROM app_logs"),
)
def features_error_keywords(spark, sf_dir):
    return E.with_error_keywords(views.app_logs(spark, sf_dir)).drop("timestamp", "level", "message")


@query(
    "features_multimodal",
    sql(f"""SELECT source, line_number, hour(timestamp) AS hour, minute(timestamp) AS minute, day(timestamp) AS day,
  CAST({DOW} AS BIGINT) AS weekday, month(timestamp) AS month, length(message) AS message_length, {_count_of(' ', 'message')} AS space_count,
  {_count_of('ERROR', 'message')} AS error_count, {_count_of('WARNING', 'message')} AS warning_count, {_count_of('INFO', 'message')} AS info_count FROM app_logs"""),
)
def features_multimodal(spark, sf_dir):
    return E.with_multimodal_features(views.app_logs(spark, sf_dir)).drop("timestamp", "level", "message")


@query(
    "features_streaming",
    sql(f"""SELECT source, line_number, length(line) AS message_length, {_count_of('ERROR', 'line')} AS error_count,
  {_count_of('WARNING', 'line')} AS warning_count, {_count_of('INFO', 'line')} AS info_count,
  len(regexp_extract_all(line, '\\S+')) AS word_count FROM raw_lines""".replace("\\\\", "\\"), "raw_lines"),
)
def features_streaming(spark, sf_dir):
    lines = views.raw_lines(spark, sf_dir).withColumnRenamed("line", "message")
    return E.with_stream_features(lines).drop("message")


SHAPE_SQL = f"""SELECT source, line_number, length(message) AS message_length, {WORDS} AS word_count,
  CAST(CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 1 END AS BIGINT) AS severity_score,
  hour(timestamp) AS hour, CAST({DOW} AS BIGINT) AS day_of_week, len(list_distinct(string_split(message, ''))) AS char_diversity,
  length(regexp_replace(message, '[a-zA-Z0-9]', '', 'g')) / length(message) AS special_char_ratio FROM app_logs"""
SHAPE = ["message_length", "word_count", "severity_score", "hour", "day_of_week", "char_diversity", "special_char_ratio"]


@query(
    "features_text_shape",
    sql(f"SELECT * REPLACE (round(special_char_ratio, 6) AS special_char_ratio, CAST(char_diversity AS BIGINT) AS char_diversity) FROM ({SHAPE_SQL})"),
)
def features_text_shape(spark, sf_dir):
    rows = E.with_text_shape(views.app_logs(spark, sf_dir)).select(*KEY, *SHAPE)
    return rounded(rows, "special_char_ratio")


@query(
    "level_onehot",
    sql("SELECT source, line_number, " + ", ".join(
        f"CAST(upper(level) = '{lv}' AS INT) AS level_{lv}" for lv in ("CRITICAL", "DEBUG", "ERROR", "INFO", "WARN", "WARNING")
    ) + " FROM app_logs"),
)
def level_onehot(spark, sf_dir):
    named = ("CRITICAL", "DEBUG", "ERROR", "INFO", "WARN", "WARNING")
    return E.level_one_hot(views.app_logs(spark, sf_dir), named).drop("timestamp", "level", "message")


@query(
    "level_index",
    sql("SELECT source, line_number, dense_rank() OVER (ORDER BY upper(level)) - 1 AS level_index FROM app_logs WHERE level IS NOT NULL"),
)
def level_index(spark, sf_dir):
    """All levels told apart, however many there are."""
    rows = E.with_level_index(views.app_logs(spark, sf_dir).where("level IS NOT NULL"))
    return rows.select("source", "line_number", "level_index")


@query(
    "hashed_terms",
    sql(r""", tk AS (SELECT source, line_number, unnest(list_filter(regexp_extract_all(lower(message), '\b\w\w+\b'), lambda x: NOT list_contains(""" + _stop_list() + """, x))) AS term FROM app_logs),
hs AS (SELECT source, line_number, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 5000 AS INT) AS idx, CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END AS sign FROM tk),
sm AS (SELECT source, line_number, idx, sum(sign) AS total FROM hs GROUP BY ALL HAVING sum(sign) <> 0)
SELECT source, line_number, idx, round(total / sqrt(sum(total * total) OVER (PARTITION BY source, line_number)), 6) AS value FROM sm"""),
)
def hashed(spark, sf_dir):
    """Signed feature hashing without a vocabulary."""
    from logharbor.operators.term_space import hashed_terms
    from logharbor.operators.tfidf import tokens

    rows = views.app_logs(spark, sf_dir).withColumn("terms", tokens(F.coalesce("message", F.lit(""))))
    return rounded(hashed_terms(rows, ["source", "line_number"], "terms"), "value")


@query(
    "time_diff",
    sql("""SELECT source, line_number, round(coalesce(date_diff('microsecond',
  lag(timestamp) OVER (PARTITION BY source ORDER BY line_number), timestamp) / 1e6, 0), 6) AS time_diff_seconds FROM app_logs"""),
)
def time_diff(spark, sf_dir):
    rows = E.with_time_diff(views.app_logs(spark, sf_dir))
    return rounded(rows.select(*KEY, "time_diff_seconds"), "time_diff_seconds")


@query(
    "log_frequency_5min",
    sql("""SELECT source, line_number, count(*) OVER (ORDER BY timestamp RANGE BETWEEN INTERVAL 150 SECOND PRECEDING
  AND INTERVAL 150 SECOND FOLLOWING) AS log_frequency_5min FROM app_logs"""),
)
def log_frequency_5min(spark, sf_dir):
    rows = E.with_log_frequency(views.app_logs(spark, sf_dir))
    return rows.select(*KEY, "log_frequency_5min")


def tfidf_cte(text: str, max_features: int, bigrams: bool, min_df: int = 1, max_df: float = 1.0) -> str:
    """CTEs ``terms`` (key, term, tf), ``vocabulary`` and ``weights`` over ``app_logs``."""
    both = "list_concat(ws, [ws[i] || ' ' || ws[i+1] for i in range(1, len(ws))])" if bigrams else "ws"
    return rf""", toks AS (SELECT source, line_number, list_filter(regexp_extract_all(lower({text}), '\b\w\w+\b'),
    lambda x: NOT list_contains({_stop_list()}, x)) AS ws FROM app_logs),
terms AS (SELECT source, line_number, term, count(*) AS tf FROM (SELECT source, line_number, unnest({both}) AS term FROM toks) GROUP BY ALL),
corpus AS (SELECT count(*) AS n FROM app_logs),
vocabulary AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS df, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf
  FROM terms, corpus GROUP BY term HAVING count(*) >= {min_df} AND count(*) <= {max_df} * any_value(n) ORDER BY total DESC, term LIMIT {max_features}),
weights AS (SELECT source, line_number, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY source, line_number)) AS weight
  FROM terms JOIN vocabulary USING (term))
"""


@query(
    "tfidf_top_terms",
    sql(tfidf_cte("message", 100, True) + """SELECT v.term, v.total, v.df, round(v.idf, 6) AS idf, round(sum(w.weight), 4) AS weight_sum
FROM vocabulary v JOIN weights w USING (term) GROUP BY ALL"""),
)
def tfidf_top_terms(spark, sf_dir):
    logs = views.app_logs(spark, sf_dir)
    terms = T.term_counts(logs, KEY, F.col("message"))
    vocabulary = T.vocabulary(terms, logs, max_features=100)
    sums = T.weights(terms, vocabulary, KEY).groupBy("term").agg(F.round(F.sum("weight"), 4).alias("weight_sum"))
    return rounded(vocabulary.join(sums, "term"), "idf")


@query(
    "tfidf_weights",
    sql(tfidf_cte("message", 5000, True, 2, 0.95) + "SELECT source, line_number, term, round(weight, 6) AS weight FROM weights"),
)
def tfidf_weights(spark, sf_dir):
    logs = views.app_logs(spark, sf_dir)
    terms = T.term_counts(logs, KEY, F.col("message"))
    vocabulary = T.vocabulary(terms, logs, max_features=5000, min_df=2, max_df=0.95)
    return rounded(T.weights(terms, vocabulary, KEY).select(*KEY, "term", "weight"), "weight")


@query(
    "word_frequency",
    sql(rf""", p AS (SELECT unnest(list_filter(string_split({TEMPLATE_SQL}, ' '), lambda x: x <> '')) AS word FROM app_logs)
SELECT word, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS frequency FROM p GROUP BY word"""),
)
def word_frequency(spark, sf_dir):
    return rounded(T.word_frequencies(views.app_logs(spark, sf_dir)), "frequency", digits=9)


_NUMERIC = ["message_length", "word_count", "severity_score", "hour", "day_of_week"]


def _scaled_sql(expression: str) -> str:
    stats = ", ".join(
        f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s, quantile_cont({c}::DOUBLE, 0.25) AS {c}_a, "
        f"quantile_cont({c}::DOUBLE, 0.5) AS {c}_b, quantile_cont({c}::DOUBLE, 0.75) AS {c}_c" for c in _NUMERIC
    )
    columns = ", ".join(f"round({expression.replace('#', c)}, 6) AS {c}" for c in _NUMERIC)
    return sql(f""", f AS (SELECT source, line_number, length(message) AS message_length, {WORDS} AS word_count, {SEVERITY_CORE} AS severity_score,
  hour(timestamp) AS hour, {DOW} AS day_of_week FROM app_logs), s AS (SELECT {stats} FROM f)
SELECT source, line_number, {columns} FROM f, s""")


@query("standard_scale", _scaled_sql("(# - #_m) / (CASE WHEN #_s = 0 THEN 1 ELSE #_s END)"))
def standard_scale(spark, sf_dir):
    rows = E.with_basic_features(views.app_logs(spark, sf_dir))
    stats = fitted(profile(rows, _NUMERIC, quartiles=False))
    scaled = [standard_scaled(F.col(c), stats[f"{c}_mean"], stats[f"{c}_std"]).alias(c) for c in _NUMERIC]
    return rounded(rows.select(*KEY, *scaled), *_NUMERIC)


@query("robust_scale", _scaled_sql("(# - #_b) / (CASE WHEN #_c = #_a THEN 1 ELSE #_c - #_a END)"))
def robust_scale(spark, sf_dir):
    rows = E.with_basic_features(views.app_logs(spark, sf_dir))
    stats = fitted(profile(rows, _NUMERIC))
    scaled = [robust_scaled(F.col(c), stats[f"{c}_q"]).alias(c) for c in _NUMERIC]
    return rounded(rows.select(*KEY, *scaled), *_NUMERIC)


@query(
    "column_profile",
    """WITH e AS (SELECT count(*) AS n, min(event_id) AS a1, max(event_id) AS b1, min(user_id) AS a2, max(user_id) AS b2, min(value) AS a3, max(value) AS b3,
  count(DISTINCT event_type) AS d1, count(DISTINCT props) AS d2 FROM events),
r AS (SELECT 'event_id' AS column_name, 'bigint' AS current_type, a1::DOUBLE AS min_value, b1::DOUBLE AS max_value, NULL::DOUBLE AS distinct_ratio FROM e
UNION ALL SELECT 'user_id', 'bigint', a2, b2, NULL FROM e UNION ALL SELECT 'value', 'double', a3, b3, NULL FROM e
UNION ALL SELECT 'event_type', 'string', NULL, NULL, d1 / n FROM e UNION ALL SELECT 'props', 'string', NULL, NULL, d2 / n FROM e)
SELECT column_name, current_type, min_value, max_value, round(distinct_ratio, 6) AS distinct_ratio,
  CASE WHEN current_type = 'double' THEN 'float' WHEN current_type = 'string' THEN CASE WHEN distinct_ratio < 0.5 THEN 'categorical' ELSE 'string' END
    WHEN min_value >= -128 AND max_value <= 127 THEN 'tinyint' WHEN min_value >= -32768 AND max_value <= 32767 THEN 'smallint'
    WHEN max_value <= 2147483647 THEN 'int' ELSE 'bigint' END AS suggested_type FROM r""",
)
def column_profile(spark, sf_dir):
    return rounded(E.column_profile(views.table(spark, sf_dir, "events")), "distinct_ratio")


@query(
    "csv_enriched",
    sql(f"""SELECT line_number, source, timestamp, level, message, is_anomaly, round(anomaly_score, 6) AS anomaly_score, length(message) AS message_length,
  {WORDS} AS word_count, hour(timestamp) AS hour, CAST({DOW} AS BIGINT) AS day_of_week, {DOW} IN (5, 6) AS is_weekend,
  CAST(CASE level WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2 WHEN 'WARN' THEN 3 WHEN 'ERROR' THEN 4 END AS BIGINT) AS severity_score,
  CASE WHEN anomaly_score <= 0.3 THEN 'Low' WHEN anomaly_score <= 0.7 THEN 'Medium' ELSE 'High' END AS confidence_level FROM logs""", "logs"),
)
def csv_enriched(spark, sf_dir):
    return rounded(E.with_csv_enrichment(views.scored_logs(spark, sf_dir)), "anomaly_score")

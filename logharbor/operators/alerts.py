"""Alerts from flagged rows: severity, texts, windows, thresholds and throttling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logharbor import constants as K
from logharbor.config import AlertConfig
from logharbor.functions.ordering import epoch_micros
from logharbor.functions.text import contains_any
from logharbor.operators.report import flagged, percent, risk_of, rows_counted


def alert_severity(level: Column, score: Column) -> Column:
    upper = F.upper(F.coalesce(level, F.lit("INFO")))
    value = F.coalesce(score, F.lit(0.5))
    return (
        F.when((upper == "ERROR") | (value > 0.9), "CRITICAL")
        .when((upper == "WARNING") | (value > 0.7), "WARNING")
        .otherwise("INFO")
    )


def _with_level(title: str, level: Column) -> Column:
    head, tail = title.split("{level}")
    return F.concat(F.lit(head), level, F.lit(tail))


def alert_title(severity: Column, level: Column, message: Column) -> Column:
    lowered = F.lower(message)
    text = (
        F.when(lowered.contains("error"), _with_level(K.TITLE_ERROR, level))
        .when(lowered.contains("exception"), F.lit(K.TITLE_EXCEPTION))
        .when(lowered.contains("fail"), F.lit(K.TITLE_FAILURE))
        .otherwise(_with_level(K.TITLE_OTHER, level))
    )
    return F.concat(severity, F.lit(": "), text)


def alert_tags(level: Column, message: Column, config: AlertConfig) -> Column:
    lowered = F.lower(message)
    fixed = [F.lit(t) for t in (config.source_name, "anomaly", *config.extra_tags)]
    by_keyword = [
        F.when(contains_any(lowered, keywords), F.lit(tag)) for tag, keywords in K.ALERT_TAG_KEYWORDS
    ]
    return F.array_compact(F.array(*fixed, F.concat(F.lit("level:"), F.lower(level)), *by_keyword))


def alerts(df: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """One alert per flagged row. The id is a stable hash of the message."""
    level = F.coalesce(F.col("level"), F.lit("INFO"))
    message = F.coalesce(F.col("message"), F.lit(""))
    actions = {s: F.array(*[F.lit(a) for a in texts]) for s, texts in K.ALERT_ACTIONS.items()}
    rows = df.where(flagged()).withColumn("severity", alert_severity(level, F.col("anomaly_score")))
    severity = F.col("severity")
    return rows.select(
        F.md5(message).alias("id"),
        *[c for c in ("source", "line_number") if c in df.columns],
        "timestamp",
        "severity",
        alert_title(severity, level, message).alias("title"),
        F.substring(message, 1, 500).alias("description"),
        F.coalesce(F.col("anomaly_score"), F.lit(0.5)).alias("anomaly_score"),
        level.alias("log_level"),
        F.lit(config.source_name).alias("origin"),
        alert_tags(level, message, config).alias("tags"),
        F.when(severity == "CRITICAL", actions["CRITICAL"])
        .when(severity == "WARNING", actions["WARNING"])
        .otherwise(actions["INFO"]).alias("actions"),
    )


def alert_summary(found: DataFrame, tags: int = 5) -> DataFrame:
    """Counts per severity, the most common tags and the time span, as one row."""
    top = (
        found.select(F.explode("tags").alias("tag"))
        .groupBy("tag").agg(rows_counted().alias("n"))
        .orderBy(F.desc("n"), "tag").limit(tags)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "tag"))).alias("t"))
        .select(F.transform("t", lambda t: t["tag"]))
    )
    return found.agg(
        rows_counted().alias("total_alerts"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_alerts"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_alerts"),
        F.count_if(F.col("severity") == "INFO").alias("info_alerts"),
        F.min("timestamp").alias("first_alert"),
        F.max("timestamp").alias("last_alert"),
    ).withColumn("most_common_tags", top.scalar())


def notification(df: DataFrame, generated_at: Column) -> DataFrame:
    """A message with counts and, above 5 % and 10 %, a warning block, as JSON text."""
    stats = df.agg(
        rows_counted().alias("total_logs"),
        F.count_if(flagged()).alias("anomalies"),
        percent(F.count_if(flagged()), rows_counted()).alias("anomaly_rate"),
    )
    rate = F.col("anomaly_rate")
    warning = F.when(rate > 10, K.WARNING_HIGH).when(rate > 5, K.WARNING_ELEVATED)
    rows = stats.withColumn("generated", F.date_format(generated_at, "yyyy-MM-dd HH:mm")).withColumn(
        "warning", warning
    ).withColumn("risk", risk_of(rate, inclusive=False))
    field = lambda label, value: F.concat(F.lit(f"*{label}:* "), value)
    blocks = F.array_compact(
        F.array(
            F.lit("Log analysis report"),
            field("Total Logs", F.format_number("total_logs", 0)),
            field("Anomalies", F.format_number("anomalies", 0)),
            field("Anomaly Rate", F.concat(F.format_number("anomaly_rate", 2), F.lit("%"))),
            field("Generated", F.col("generated")),
            F.col("warning"),
        )
    )
    return rows.withColumn("payload", F.to_json(F.struct(blocks.alias("blocks"))))


def alert_windows(df: DataFrame, config: AlertConfig = AlertConfig(), samples: int = 5) -> DataFrame:
    """Windows of each source with enough flagged rows, with their first messages.

    Counting is a plain partial aggregate. The samples are the smallest lines of each
    window, kept by a bounded aggregate instead of a list of the whole window.
    """
    width = f"{config.time_window_minutes} minutes"
    hits = df.where(flagged() & F.col("timestamp").isNotNull()).withColumn(
        "window_start", F.window("timestamp", width)["start"].cast("timestamp_ntz")
    )
    counts = hits.groupBy("source", "window_start").agg(rows_counted().alias("count"))
    enough = counts.where(F.col("count") >= config.anomaly_threshold)
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("source", "window_start").orderBy("line_number"))
    first = (
        hits.withColumn("_place", place).where(F.col("_place") <= samples)
        .groupBy("source", "window_start")
        .agg(F.sort_array(F.collect_list(F.struct("line_number", "message"))).alias("_first"))
    )
    return enough.join(first, ["source", "window_start"]).select(
        "source", "window_start", "count",
        F.transform("_first", lambda r: r["message"]).alias("sample_messages"),
    )


def throttled(windows: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """Candidates that are sent: the first one of a source, then each one that comes at
    least ``throttle_minutes`` after the last sent one.

    Each source's candidates stream by in order of time, with one number kept; there is at most
    one per time window, so their number depends on the age of the log and not on its volume.
    """
    pause = config.throttle_minutes * 60 * 1_000_000
    schema = windows.schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for batch in batches:
            sent = []
            for source, us in zip(batch["source"], batch["_us"]):
                if source != current:
                    current, last = source, None
                sent.append(last is None or us >= last + pause)
                last = us if sent[-1] else last
            yield batch.loc[sent, schema.names]

    return (
        windows.withColumn("_us", epoch_micros(F.col("window_start")))
        .repartition("source")
        .sortWithinPartitions("source", "_us")
        .mapInPandas(fold, schema)
    )

"""Writers for detected rows and report data sets; each is a plain Spark write."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logharbor import constants as K
from logharbor.config import AlertConfig
from logharbor.operators import report as R
from logharbor.operators.alerts import alert_summary, alerts, notification
from logharbor.operators.features import with_csv_enrichment
from logharbor.session import durable


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, include_index: bool = False) -> None:
    """Nulls are written; ``_index`` is the line number."""
    rows = df.withColumn("_index", F.col("line_number")) if include_index else df
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_enriched_csv(df: DataFrame, path: str) -> None:
    """Rows with analysis columns in ``path/rows``, totals in ``path/metadata``."""
    df = durable(df)  # Several tables follow from the rows; the detector runs once.
    with_csv_enrichment(df).write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    R.processing_statistics(df).write.mode("overwrite").option("header", True).csv(f"{path}/metadata")


def write_xml(df: DataFrame, path: str) -> None:
    """One element per row with its anomaly information, and an element with the totals."""
    df = durable(df)  # Several tables follow from the rows; the detector runs once.
    info = [F.col("is_anomaly"), F.round("anomaly_score", 4).alias("score")]
    if "cluster_id" in df.columns:
        info.append(F.col("cluster_id"))
    entries = df.select(
        F.col("line_number").alias("_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("timestamp", "level", "message")],
        F.struct(*info).alias("anomaly_info"),
    )
    _xml(entries, f"{path}/rows", "logs", "log_entry")
    _xml(R.processing_statistics(df), f"{path}/metadata", "results", "metadata")


#: Elements of an XML file; a reader takes a file in one task.
_ELEMENTS_PER_FILE = 200_000


def _xml(df: DataFrame, path: str, root: str, row: str) -> None:
    df.write.mode("overwrite").format("xml").option("maxRecordsPerFile", _ELEMENTS_PER_FILE).option("rootTag", root).option("rowTag", row).save(path)


def write_alerts(df: DataFrame, path: str, config: AlertConfig = AlertConfig()) -> None:
    found = alerts(df, config)
    write_json(found, f"{path}/alerts")
    write_json(alert_summary(found), f"{path}/summary")


def write_time_series(df: DataFrame, path: str) -> None:
    df = durable(df)  # Several tables follow from the rows; the detector runs once.
    sections = {
        "findings": R.time_findings(df),
        "hours": R.hour_pattern(df),
        "weekdays": R.weekday_pattern(df),
        "anomalies": R.anomaly_patterns(df),
        "trend": R.daily_trend(df),
        "seasonality": R.seasonality(df),
    }
    for name, section in sections.items():
        write_json(section, f"{path}/{name}")


def write_compliance(df: DataFrame, path: str, standard: str = "ISO 27001", auditor: str = "logharbor") -> None:
    df = durable(df)  # Several tables follow from the rows; the detector runs once.
    summary = R.compliance_counts(df).select(
        F.lit(standard).alias("standard"), F.lit(auditor).alias("auditor"), "*",
        F.array(*[F.lit(a) for a in K.COMPLIANCE_ADVICE]).alias("recommendation"),
    )
    _xml(summary, f"{path}/summary", "compliance_report", "summary")
    _xml(R.compliance_findings(df), f"{path}/findings", "compliance_report", "finding")


def dashboard(df: DataFrame) -> dict[str, DataFrame]:
    """The data sets of a dashboard, each small enough to draw."""
    return {
        "summary": R.summary(df),
        "timeline": R.hourly_timeline_dense(df),
        "levels": R.level_distribution(df),
        "scores": R.score_histogram(df),
        "top_anomalies": R.top_anomalies(df, 10),
        "hours": R.anomaly_hours(df),
    }


def write_dashboard(df: DataFrame, path: str) -> None:
    df = durable(df)  # Several tables follow from the rows; the detector runs once.
    for name, section in dashboard(df).items():
        write_json(section, f"{path}/{name}")


def write_notification(df: DataFrame, path: str) -> None:
    now = F.current_timestamp()
    notification(df, now).select("payload").write.mode("overwrite").text(path)

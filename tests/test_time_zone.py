"""Clock arithmetic does not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.functions.ordering import epoch_micros, hour_start, micros_between


def test_spring_forward(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        frame = spark.sql(
            "SELECT TIMESTAMP_NTZ'2024-03-31 01:59:59.25' AS a, TIMESTAMP_NTZ'2024-03-31 02:30:00.5' AS b"
        )
        row = frame.select(
            epoch_micros(F.col("b")).alias("us"),
            hour_start(F.col("b")).cast("string").alias("hour"),
            micros_between(F.col("a"), F.col("b")).alias("gap"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row["us"] == 1711852200500000
    assert row["hour"] == "2024-03-31 02:00:00"
    assert row["gap"] == 1801250000

from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


def make_session():
    from logharbor import build_session

    spark = build_session(
        "local[8]",
        "logharbor-tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="logharbor-tests-"),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    from logharbor.session import clear_shared

    session = make_session()
    yield session
    clear_shared(session)


@pytest.fixture
def log_rows(spark):
    """Rows (source, line_number, timestamp text, level, message) as a typed log table."""

    def build(rows):
        frame = spark.createDataFrame(
            rows, "source string, line_number bigint, timestamp string, level string, message string"
        )
        return frame.selectExpr(
            "source", "line_number", "CAST(timestamp AS timestamp_ntz) AS timestamp", "level", "message"
        )

    return build

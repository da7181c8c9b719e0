"""Every registered query runs; those with SQL give exactly what the SQL gives."""

from __future__ import annotations

import pytest

from logharbor.plans.catalog import ORACLES, QUERIES
from tests.compare import compare, duck
from tests.conftest import SF

# Too few flagged rows at the smallest scale; tests.compare at 0.01 gives rows for all.
SPARSE = {"alert_windows", "alert_throttle", "stream_alert_windows", "stream_alert_throttle"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, rows = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert verdict in ("ok", "rows-only"), verdict
    assert rows > 0 or name in SPARSE


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["hour", "anomalies", "total"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

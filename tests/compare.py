"""Runs queries next to their SQL and compares names, types and values.

Usage: python -m tests.compare [sf_dir] [query …]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int",
    "float": "double", "double": "double", "string": "string", "varchar": "string",
    "boolean": "boolean", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date",
}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (int, str)):
        return str(value)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def compare(spark, con, name, query, sql, sf_dir) -> tuple[str, int]:
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    spark_types = {f: _KINDS.get(t, t) for f, t in frame.dtypes}
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in frame.collect())
    if sql is None:
        return ("rows-only" if got else "EMPTY"), len(got)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    rows = result.fetchall()
    types = {n: _KINDS.get(str(t).lower(), str(t).lower()) for n, t in zip(names, [d[1] for d in result.description])}
    if sorted(names) != columns:
        return f"COLUMNS {columns} vs {sorted(names)}", len(got)
    differing = {c: (spark_types[c], types[c]) for c in columns if spark_types[c] != types[c]}
    if differing:
        return f"TYPES {differing}", len(got)
    order = [names.index(c) for c in columns]
    expected = sorted(tuple(canonical(r[i]) for i in order) for r in rows)
    if len(expected) != len(got):
        return f"ROWS {len(got)} vs {len(expected)}", len(got)
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    if wrong:
        return f"VALUES {len(wrong)} differ, e.g. {columns}\n     got {wrong[0][0]}\n     exp {wrong[0][1]}", len(got)
    return "ok", len(got)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = make_session(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            verdict, n = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            verdict, n = f"FAILED {type(exc).__name__}: {str(exc)[:900]}", 0
        bad += verdict not in ("ok", "rows-only")
        print(f"{name:28s} {n:7d} rows {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{bad} not in order")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

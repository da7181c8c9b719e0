from __future__ import annotations

import pytest

from logharbor.config import ConfigError, ParserConfig
from logharbor.functions import text as X
from logharbor.operators.parsing import LogParser, compile_pattern, parse_access_log
from logharbor.sources.text import admission_audit, lines_from_memory, read_admitted, read_log_lines
from pyspark.sql import functions as F


def parsed(spark, lines, config=None):
    rows = LogParser(config).parse(lines_from_memory(spark, lines))
    return {r["line_number"]: r.asDict() for r in rows.collect()}


def test_levels_and_order(spark):
    lines = [
        f"2024-01-01 12:0{i}:00 {level} message {i}"
        for i, level in enumerate(["INFO", "INFO", "WARN", "ERROR", "ERROR", "INFO"])
    ]
    rows = parsed(spark, lines)
    assert [rows[i]["level"] for i in range(1, 7)] == ["INFO", "INFO", "WARN", "ERROR", "ERROR", "INFO"]
    assert rows[4]["message"] == "message 3" and str(rows[4]["timestamp"]) == "2024-01-01 12:03:00"


def test_first_pattern_wins_and_nothing_is_lost(spark):
    rows = parsed(spark, [
        "2024-01-01 12:00:00 INFO fine", "no header here", "", "   ", "2024/01/01 12:00:00 NOTICE other shape",
        "2024-01-01 12:00:00 WARNING unknown level", "noise 2024-01-01 12:00:00 ERROR found inside",
        "2024-01-01 12:00:100 INFO three digits", "2024/13/45 12:00:00 INFO bad date",
    ])
    assert set(rows) == {1, 2, 5, 6, 7, 8, 9}
    assert rows[2]["level"] == "UNPARSED" and rows[2]["message"] == "no header here"
    assert rows[5]["level"] == "NOTICE" and rows[6]["level"] == "UNPARSED" and rows[8]["level"] == "UNPARSED"
    assert rows[7]["message"] == "found inside"
    assert rows[9]["timestamp"] is None and rows[9]["timestamp_raw"] == "2024/13/45 12:00:00"


def test_missing_groups_and_extra_fields(spark):
    config = {"log_patterns": [{"pattern": r"(?P<ip_addr>\d+\.\d+) (?P<user>\w+)?;"}, "bad entry", {"x": 1}]}
    parser = LogParser(config)
    assert parser.supported_fields() == ["ip_addr", "level", "line_number", "message", "timestamp", "user"]
    rows = {r["line_number"]: r for r in parser.parse(lines_from_memory(spark, ["1.2 bob;", "1.2 ;", "x"])).collect()}
    assert rows[1]["user"] == "bob" and rows[1]["level"] == "UNKNOWN" and rows[1]["message"] == "1.2 bob;"
    assert rows[2]["user"] is None and rows[3]["level"] == "UNPARSED"


def test_separator_characters_in_a_line_are_kept(spark):
    rows = parsed(spark, ["2024-01-01 12:00:00 INFO left\x01right", "2024/01/01 12:00:00 X a\x01b", "a\x01b"])
    assert rows[1]["message"] == "left\x01right" and rows[2]["level"] == "X" and rows[3]["level"] == "UNPARSED"


def test_unicode_words_and_spaces(spark):
    rows = parsed(spark, [" 2024/01/01 12:00:00 ÄRGER überlauf　"])
    assert rows[1]["level"] == "ÄRGER" and rows[1]["message"] == "überlauf"


def test_no_patterns_and_bad_patterns(spark):
    assert parsed(spark, ["anything"], {})[1]["level"] == "UNPARSED"
    for bad in ("(unclosed", "x" * 501):
        with pytest.raises(ConfigError):
            compile_pattern(bad)
    with pytest.raises(ConfigError):
        ParserConfig.from_dict(["not", "a", "mapping"])


def test_explicit_formats(spark):
    config = ParserConfig(patterns=(r"\[(?P<timestamp>[^\]]+)\] (?P<message>.*)",), timestamp_formats=("dd.MM.yyyy HH:mm", "yyyy-MM-dd HH:mm"))
    rows = parsed(spark, ["[01.02.2024 03:04] a", "[2024-05-06 07:08] b", "[soon] c"], config)
    assert str(rows[1]["timestamp"]) == "2024-02-01 03:04:00" and str(rows[2]["timestamp"]) == "2024-05-06 07:08:00"
    assert rows[3]["timestamp"] is None


def test_access_log(spark):
    lines = [
        '10.0.0.1 - - [02/Jan/2024:03:04:05 +0200] "GET /a HTTP/1.1" 503 - "-" "agent"',
        '10.0.0.1 - - [someday] "GET /a HTTP/1.1" 404 12 "-" "agent"',
        "not an access line",
    ]
    rows = parse_access_log(lines_from_memory(spark, lines)).orderBy("line_number").collect()
    assert len(rows) == 2
    assert (rows[0]["level"], rows[0]["response_size"], str(rows[0]["timestamp"])) == ("ERROR", 0, "2024-01-02 01:04:05")
    assert (rows[1]["level"], rows[1]["message"], rows[1]["timestamp"]) == ("WARNING", "GET /a - 404", None)


def test_sanitized(spark):
    text = "a" * 10_005
    frame = spark.createDataFrame([("x\r\ny\rz\x07\tq",), (text,)], "m string")
    short, cut = [r[0] for r in frame.select(X.sanitized(F.col("m"))).collect()]
    assert short == "x\ny\nz\tq" and cut == "a" * 10_000 + "...[TRUNCATED]"


def test_line_numbers_over_many_blocks(spark, tmp_path):
    lines = [f"line {i}" if i % 7 else "" for i in range(1, 3001)]
    (tmp_path / "one.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.log").write_bytes(b"first\nbad \xff byte\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        frame = read_log_lines(spark, str(tmp_path))
        rows = [r for r in frame.collect() if r["source"].endswith("one.log")]
        other = sorted((r["line_number"], r["line"]) for r in frame.collect() if r["source"].endswith("two.log"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["line_number"], r["line"]) for r in rows) == list(enumerate(lines, 1))
    assert other == [(1, "first"), (2, "bad � byte")]


def test_admission(spark, tmp_path):
    (tmp_path / "a.log").write_text("1\n2\n")
    (tmp_path / "b.txt").write_text("x" * 500)
    (tmp_path / "c.exe").write_text("z")
    audit = {r["source"].rsplit("/", 1)[1]: r["reason"] for r in admission_audit(spark, str(tmp_path), max_bytes=100).collect()}
    assert audit == {"a.log": None, "b.txt": "file too large", "c.exe": "extension not allowed"}
    assert read_admitted(spark, str(tmp_path), max_bytes=100).count() == 2

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logharbor.config import AlertConfig
from logharbor.operators import alerts as A
from logharbor.operators import report as R
from logharbor.operators.parsing import LogParser
from logharbor.operators.statistical import detect_statistical
from logharbor.plans import views
from logharbor.plugins import Detector, LineParser
from logharbor.sources import sinks
from logharbor.sources.text import lines_from_memory
from logharbor.streaming import monitor as M
from tests.conftest import SF


@pytest.fixture(scope="module")
def scored(spark):
    return views.scored_logs(spark, SF).persist()


def test_row_sinks(spark, scored, tmp_path):
    n = scored.count()
    out = str(tmp_path)
    sinks.write_json(scored, f"{out}/j")
    sinks.write_csv(scored, f"{out}/c")
    with_null = scored.withColumn("extra", F.lit(None).cast("string"))
    sinks.write_json_lines(with_null, f"{out}/l", include_index=True)
    sinks.write_enriched_csv(scored, f"{out}/e")
    sinks.write_xml(scored.withColumn("cluster_id", F.lit(3)), f"{out}/x")
    assert spark.read.json(f"{out}/j").count() == n
    assert spark.read.option("header", True).csv(f"{out}/c").count() == n
    lines = spark.read.text(f"{out}/l")
    assert lines.where(F.col("value").contains('"extra":null')).count() == n
    assert spark.read.json(f"{out}/l").where("_index = line_number").count() == n
    enriched = spark.read.option("header", True).csv(f"{out}/e/rows")
    assert {"word_count", "is_weekend", "confidence_level"} <= set(enriched.columns) and enriched.count() == n
    xml = spark.read.format("xml").option("rowTag", "log_entry").load(f"{out}/x/rows")
    assert xml.count() == n and xml.where("anomaly_info.cluster_id = 3").count() == n
    total = spark.read.format("xml").option("rowTag", "metadata").load(f"{out}/x/metadata").first()
    assert total["processed"] == n


def test_report_sinks(spark, scored, tmp_path):
    out = str(tmp_path)
    sinks.write_alerts(scored, f"{out}/a")
    sinks.write_time_series(scored, f"{out}/t")
    sinks.write_compliance(scored, f"{out}/k")
    sinks.write_dashboard(scored, f"{out}/d")
    sinks.write_notification(scored, f"{out}/n")
    hits = scored.where("is_anomaly = 1").count()
    assert spark.read.json(f"{out}/a/alerts").count() == hits
    assert spark.read.json(f"{out}/a/summary").first()["total_alerts"] == hits
    assert spark.read.json(f"{out}/t/hours").count() == 24
    assert spark.read.format("xml").option("rowTag", "summary").load(f"{out}/k/summary").first()["total_entries"] == scored.count()
    assert spark.read.json(f"{out}/d/hours").agg(F.sum("anomalies")).first()[0] == hits
    assert spark.read.text(f"{out}/n").first()[0].startswith('{"blocks":[')


def test_threshold_and_throttle(spark, log_rows):
    start = dt.datetime(2024, 1, 1)
    rows = [("s", i, str(start + dt.timedelta(minutes=i)), "ERROR", f"m{i}") for i in range(120)]
    rows += [("quiet", i, str(start + dt.timedelta(minutes=30 * i)), "ERROR", "x") for i in range(4)]
    flagged = log_rows(rows).withColumn("is_anomaly", F.lit(1))
    config = AlertConfig(anomaly_threshold=5, time_window_minutes=5, throttle_minutes=15)
    windows = A.alert_windows(flagged, config)
    assert windows.count() == 24 and windows.where("source = 'quiet'").count() == 0
    first = windows.orderBy("window_start").first()
    assert first["count"] == 5 and first["sample_messages"] == [f"m{i}" for i in range(5)]
    sent = sorted(r["window_start"].minute + 60 * r["window_start"].hour for r in A.throttled(windows, config).collect())
    assert sent == [0, 15, 30, 45, 60, 75, 90, 105]


def test_risk_edges(spark):
    frame = spark.createDataFrame([(r,) for r in (10.0, 5.0, 10.1, 4.9)], "r double")
    got = [tuple(x) for x in frame.select(R.risk_of(F.col("r"), False), R.risk_of(F.col("r"), True)).collect()]
    assert got == [("MEDIUM", "HIGH"), ("LOW", "MEDIUM"), ("HIGH", "HIGH"), ("LOW", "LOW")]


def test_reports_of_empty_and_single_day(spark, log_rows):
    one = log_rows([("s", 1, "2024-01-01 05:00:00", "INFO", "m")]).withColumn("is_anomaly", F.lit(0)).withColumn("anomaly_score", F.lit(0.0))
    assert R.daily_trend(one).isEmpty() and R.seasonality(one).isEmpty()
    findings = R.time_findings(one).first()
    assert findings["key_findings"][0] == "Peak activity occurs at 5:00 hours"
    assert R.summary(one.limit(0)).first()["anomaly_percentage"] == 0.0
    assert R.hourly_timeline_dense(one.limit(0)).isEmpty()


def _follow(spark, folder, progress, out, detect):
    stream = M.parsed_stream(M.follow_directory(spark, folder, "*.log", files_per_trigger=1))
    M.start(stream, M.scoring_batches(detect, out), progress).awaitTermination()


def test_follow_files_and_resume(spark, tmp_path):
    """New files are read once; the rows equal those of a batch over the same lines."""
    folder, progress, out = (str(tmp_path / n) for n in ("logs", "progress", "out"))
    (tmp_path / "logs").mkdir()
    texts = {f"{i}.log": [f"2024-01-01 12:00:{j:02d} INFO file {i} line {j}" for j in range(20)] for i in range(3)}
    seen = []

    def deliver(rows, number):
        seen.append(rows.count())

    flag_all = lambda df: df.withColumn("is_anomaly", F.lit(1)).withColumn("anomaly_score", F.lit(1.0))
    for name in ("0.log", "1.log"):
        (tmp_path / "logs" / name).write_text("\n".join(texts[name]) + "\n")
    _follow(spark, folder, progress, out, flag_all)
    assert spark.read.parquet(out).count() == 40
    (tmp_path / "logs" / "2.log").write_text("\n".join(texts["2.log"]) + "\n")
    _follow(spark, folder, progress, out, flag_all)
    streamed = sorted(r["message"] for r in spark.read.parquet(out).collect())
    batch = LogParser().parse(lines_from_memory(spark, [t for ts in texts.values() for t in ts]))
    assert streamed == sorted(r["message"] for r in batch.collect())
    write = M.scoring_batches(flag_all, str(tmp_path / "other"), deliver)
    write(batch, 0)
    write(batch, 0)
    assert seen == [60, 60] and spark.read.parquet(str(tmp_path / "other")).count() == 60


def test_state_carries_over_batches(spark, tmp_path):
    """Throttling and limits remember earlier batches: files arrive one per trigger."""
    base = pd.Timestamp("2024-01-01")
    minutes = [0, 5, 10, 15, 20, 29, 30, 50]
    for i, part in enumerate([minutes[:3], minutes[3:5], minutes[5:]]):
        rows = [("s", (base + pd.Timedelta(minutes=m)).to_pydatetime(), 9) for m in part]
        spark.createDataFrame(rows, "source string, window_start timestamp, count bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = (
        spark.readStream.schema("source string, window_start timestamp, count bigint")
        .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    out = str(tmp_path / "out")
    M.start(M.throttled_alerts(stream), lambda b, n: b.write.parquet(f"{out}/batch={n}"), str(tmp_path / "p")).awaitTermination()
    sent = sorted(r["window_start"].hour * 60 + r["window_start"].minute for r in spark.read.parquet(out).collect())
    assert sent == [0, 15, 30, 50]


def test_counters(spark, scored):
    from pyspark.sql import Observation

    watch = Observation("live")
    rows = scored.observe(watch, R.rows_counted().alias("processed"), F.count_if(R.flagged()).alias("anomalies"))
    rows.write.format("noop").mode("overwrite").save()
    assert watch.get["processed"] == scored.count()
    assert M.counted(scored).count() == scored.count()


def test_plugins(spark, scored):
    class Mine(Detector):
        def transform(self, df):
            return detect_statistical(df)

    found = scored.drop("is_anomaly", "anomaly_score").transform(Mine().fit_transform)
    assert {"is_anomaly", "anomaly_score"} <= set(found.columns)
    with pytest.raises(ValueError):
        Mine().fit_transform(spark.range(1))

    class KeyValue(LineParser):
        supported_formats = ("kv",)
        schema = StructType([StructField("k", StringType()), StructField("v", StringType())])

        def parse_line(self, line):
            left, found, right = line.partition("=")
            return {"k": left, "v": right} if found else None

    lines = lines_from_memory(spark, ["a=1", "nothing", "b=2"])
    assert [(r["line_number"], r["k"], r["v"]) for r in KeyValue().parse(lines).orderBy("line_number").collect()] == [(1, "a", "1"), (3, "b", "2")]
    assert not KeyValue().can_parse(lines) and KeyValue().can_parse(lines.where("line_number <> 2"))


def test_rate_limit_remembers_earlier_batches(spark, tmp_path):
    pick = random.Random(2)
    base, now, rows = dt.datetime(2024, 1, 1), 0, []
    for i in range(240):
        now += pick.choice([0, 1, 2, 40])
        rows.append((i, "hot" if pick.random() < 0.8 else "cold", base + dt.timedelta(seconds=now)))
    kept: dict[str, list] = {}
    expected = []
    for i, client, at in rows:
        kept[client] = [t for t in kept.get(client, []) if (at - t).total_seconds() < 60]
        expected.append((i, len(kept[client]) < 3))
        if expected[-1][1]:
            kept[client].append(at)
    schema = "request_id bigint, client_id string, ts timestamp_ntz"
    decide = M.RateLimitBatches(str(tmp_path / "out"), str(tmp_path / "state"), 3, 60)
    for number, start in enumerate((0, 80, 160)):
        batch = spark.createDataFrame(rows[start:start + 80], schema)
        decide(batch, number)
        if number == 1:
            decide(batch, number)
    got = sorted((r["request_id"], r["allowed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == expected


def test_service_levels_use_all_requests(spark):
    """A day with far more requests than any window of samples: all of them count."""
    from logharbor.operators.service import sla_metrics

    rows = spark.range(30_000).selectExpr(
        "id AS request_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts",
        "CAST(id AS DOUBLE) AS response_time", "true AS success",
    )
    found = sla_metrics(rows, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).first()
    assert (found["response_time_p50"], found["response_time_p95"], found["response_time_p99"]) == (15_000, 28_500, 29_700)


def test_thousands_of_levels(spark):
    """Two thousand levels, one of them with a third of all rows, are all told apart; wide columns are for named ones."""
    from logharbor.operators.features import level_one_hot, level_table, with_level_index

    rows = spark.range(6_000).selectExpr(
        "'s' AS source", "id AS line_number", "CASE WHEN id < 2000 THEN 'info' WHEN id = 5999 THEN NULL ELSE concat('L', id % 2000) END AS level"
    )
    found = with_level_index(rows).groupBy(F.upper("level").alias("l")).agg(F.count_distinct("level_index").alias("d"), F.min("level_index").alias("i")).collect()
    named = {r["l"]: (r["d"], r["i"]) for r in found}
    assert named.pop(None) == (0, None)
    assert sorted(i for _, i in named.values()) == list(range(2001)) and {d for d, _ in named.values()} == {1}
    assert [named[n][1] for n in sorted(named)] == list(range(2001))
    assert level_table(rows).count() == 2001
    wide = level_one_hot(rows, ["INFO", "L7"])
    assert wide.columns[-2:] == ["level_INFO", "level_L7"] and wide.agg(F.sum("level_INFO")).first()[0] == 2000


def test_format_ties_go_to_the_first_name(spark):
    from logharbor.operators.parsing import sniff_formats

    lines = spark.createDataFrame([("s", i, "x y") for i in range(5)], "source string, line_number bigint, line string")
    for names in (("b", "a"), ("a", "b")):
        assert sniff_formats(lines, {n: r"(?P<x>\w) (?P<y>\w)" for n in names}).first()["pattern"] == "a"


def test_followed_files_can_feed_detectors_by_line(spark, tmp_path):
    """Lines of followed files are numbered, so a forest can be fitted and learns over batches and restarts."""
    from logharbor.operators.features import with_basic_features
    from logharbor.operators.isolation_forest import IsolationForest

    folder, progress, out, latest = (str(tmp_path / n) for n in ("logs", "progress", "out", "latest"))
    (tmp_path / "logs").mkdir()
    learn = lambda: M.LatestRowsModel(
        lambda rows: IsolationForest(["message_length", "hour"], n_estimators=5).fit(rows), latest, keep=20
    )
    for i in range(3):
        lines = [f"2024-01-01 12:0{i}:{j:02d} INFO file {i} line {'x' * j}" for j in range(30)]
        (tmp_path / "logs" / f"{i}.log").write_text("\n".join(lines) + "\n")
        learner = learn()  # a restart before each file

        def write(rows, number, learner=learner):
            learner.score_and_learn(with_basic_features(rows), number, out)

        M.start(M.follow_directory(spark, folder, "*.log"), M.numbered_batches(write), progress).awaitTermination()
    rows = spark.read.parquet(out)
    numbers = rows.groupBy("batch", "source").agg(F.collect_set("line_number").alias("n"), F.max(F.abs("anomaly_score")).alias("top")).orderBy("batch").collect()
    assert [sorted(r["n"]) for r in numbers] == [list(range(1, 31))] * 3
    assert numbers[0]["top"] == 0 and numbers[1]["top"] > 0 and numbers[2]["top"] > 0
    assert learn().model_before(spark, 1)[0].count() == 20

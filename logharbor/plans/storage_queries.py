"""Writers, admission and stored models: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from logharbor.operators import features as E
from logharbor.operators.autoencoder import Autoencoder
from logharbor.operators.detector import AnomalyDetector
from logharbor.operators.isolation_forest import IsolationForest, IsolationForestModel
from logharbor.operators.one_class import OneClassSVM
from logharbor.operators.parsing import LogParser
from logharbor.operators.statistical import detect_statistical
from logharbor.operators.supervised import GradientBoostingSearch, RandomForestDetector
from logharbor.plans import views
from logharbor.plans.registry import query
from logharbor.plugins import LineParser, RowFormat, register_format, register_parser
from logharbor.session import shared_dir
from logharbor.sources import sinks
from logharbor.sources.text import admission_audit, read_admitted

_COLUMNS = "line_number, level, message, source, is_anomaly"
_TYPES = "line_number bigint, level string, message string, source string, is_anomaly int"
_ROWS = views.with_views("logs", f"SELECT {_COLUMNS} FROM logs")


def _selected(rows: DataFrame) -> DataFrame:
    return rows.select(*_COLUMNS.split(", "))


@query("sink_json", _ROWS)
def sink_json(spark, sf_dir):
    path = shared_dir(spark, "json")
    sinks.write_json(views.scored_logs(spark, sf_dir), path)
    return spark.read.schema(_TYPES).json(path)


@query("sink_csv", _ROWS)
def sink_csv(spark, sf_dir):
    path = shared_dir(spark, "csv")
    sinks.write_csv(_selected(views.scored_logs(spark, sf_dir)), path)
    return spark.read.schema(_TYPES).option("header", True).csv(path)


@query("sink_json_lines", views.with_views("logs", f"SELECT {_COLUMNS}, line_number AS _index FROM logs"))
def sink_json_lines(spark, sf_dir):
    path = shared_dir(spark, "json-lines")
    sinks.write_json_lines(views.scored_logs(spark, sf_dir), path, include_index=True)
    return spark.read.schema(_TYPES + ", _index bigint").json(path)


@query(
    "sink_xml",
    views.with_views("logs", "SELECT line_number, level, message, is_anomaly, round(anomaly_score, 4) AS score FROM logs"),
)
def sink_xml(spark, sf_dir):
    path = shared_dir(spark, "xml")
    sinks.write_xml(views.scored_logs(spark, sf_dir), path)
    schema = "_id bigint, level string, message string, anomaly_info struct<is_anomaly: int, score: double>"
    rows = spark.read.format("xml").option("rowTag", "log_entry").schema(schema).load(f"{path}/rows")
    return rows.select(
        F.col("_id").alias("line_number"), "level", "message", "anomaly_info.is_anomaly", "anomaly_info.score"
    )


@query("admitted_lines", views.with_views("raw_lines", "SELECT trim(line) AS line, count(*) AS n FROM raw_lines GROUP BY 1"))
def admitted_lines(spark, sf_dir):
    """Text files are read, whatever their size; files of another extension are not."""
    path = shared_dir(spark, "admitted")
    lines = views.raw_lines(spark, sf_dir).select("line")
    lines.write.text(f"{path}/part=1")
    lines.write.csv(f"{path}/part=2")
    return read_admitted(spark, f"{path}/*").groupBy(F.trim("line").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("admission", "SELECT unnest(['csv', 'txt']) AS extension, unnest([false, true]) AS admitted WHERE (SELECT count(*) FROM events) > 0")
def admission(spark, sf_dir):
    path = shared_dir(spark, "admission")
    lines = views.raw_lines(spark, sf_dir).select("line")
    lines.write.text(f"{path}/part=1")
    lines.write.csv(f"{path}/part=2")
    return admission_audit(spark, f"{path}/*/part-*").select("extension", "admitted").distinct()


@query("empty_input", "SELECT count(*) FILTER (event_id < 0) AS parsed, count(*) FILTER (event_id < 0) AS flagged FROM events")
def empty_input(spark, sf_dir):
    """Nothing parsed and nothing flagged where there are no lines."""
    none = views.raw_lines(spark, sf_dir).where("line_number < 0")
    logs = LogParser().parse(none)
    flagged = detect_statistical(views.app_logs(spark, sf_dir).where("line_number < 0"))
    return logs.agg(F.count(F.lit(1)).alias("parsed")).select(
        "parsed", flagged.agg(F.coalesce(F.sum("is_anomaly"), F.lit(0)).alias("n")).scalar().alias("flagged")
    )


def _differing(first: DataFrame, second: DataFrame) -> DataFrame:
    pairs = first.select("line_number", F.struct("is_anomaly", "anomaly_score").alias("a")).join(
        second.select("line_number", F.struct("is_anomaly", "anomaly_score").alias("b")), "line_number"
    )
    return pairs.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("differing"))


_SAME = "SELECT count(*) AS rows, count(*) FILTER (event_id < 0) AS differing FROM events"


@query("reload_isolation_forest", _SAME)
def reload_isolation_forest(spark, sf_dir):
    rows = E.with_basic_features(views.app_logs(spark, sf_dir))
    model = IsolationForest(["message_length", "severity_score", "hour"], contamination=0.05).fit(rows)
    path = shared_dir(spark, "forest")
    model.save(spark, path)
    return _differing(model.transform(rows), IsolationForestModel.load(spark, path).transform(rows))


@query("reload_random_forest", _SAME)
def reload_random_forest(spark, sf_dir):
    logs = views.app_logs(spark, sf_dir)
    detector = RandomForestDetector().fit(logs)
    path = shared_dir(spark, "random-forest")
    detector.save(path)
    return _differing(detector.transform(logs), RandomForestDetector().load(path).transform(logs))


@query("reload_one_class_svm", _SAME)
def reload_one_class_svm(spark, sf_dir):
    rows = E.with_basic_features(views.app_logs(spark, sf_dir))
    model = OneClassSVM(["message_length", "severity_score", "hour"]).fit(rows)
    path = shared_dir(spark, "machine")
    model.save(spark, path)
    return _differing(model.transform(rows), OneClassSVM.load(spark, path).transform(rows))


@query("reload_autoencoder", _SAME)
def reload_autoencoder(spark, sf_dir):
    rows = E.with_text_shape(views.app_logs(spark, sf_dir))
    model = Autoencoder().fit(rows)
    path = shared_dir(spark, "autoencoder")
    model.save(spark, path)
    return _differing(model.transform(rows), Autoencoder.load(spark, path).transform(rows))


@query("reload_boosted_trees", _SAME)
def reload_boosted_trees(spark, sf_dir):
    names = ["message_length", "word_count", "hour"]
    rows = E.with_basic_features(views.scored_logs(spark, sf_dir).drop("anomaly_score")).withColumn("label", F.col("is_anomaly").cast("double")).drop("is_anomaly")
    search = GradientBoostingSearch(names, "label", trials=1, folds=2, estimators=(5, 5), depth=(3, 3)).fit(rows)
    path = shared_dir(spark, "boosted")
    search.save(spark, path)
    return _differing(search.transform(rows), GradientBoostingSearch.load(spark, path).transform(rows))


@query("reload_general_detector", _SAME)
def reload_general_detector(spark, sf_dir):
    """Vocabulary, levels, components, scales and forest."""
    logs = views.app_logs(spark, sf_dir)
    detector = AnomalyDetector()
    detector.fit_transform(logs)
    path = shared_dir(spark, "general")
    detector.save(spark, path)
    return _differing(detector.transform(logs), AnomalyDetector.load(spark, path).transform(logs))


class _Pipes(RowFormat):
    """Fields between bars, as an example of a format of one's own."""

    name = "piped"

    def line(self, row):
        return "|".join("" if v is None else str(v) for v in row)


class _PipedLines(LineParser):
    schema = StructType().add("line_number", "long").add("level", "string").add("message", "string").add("source", "string").add("is_anomaly", "integer")

    def parse_line(self, line):
        parts = line.split("|")
        if len(parts) < 5:
            return None
        number, level, *message, source, flag = parts
        return {"line_number": int(number), "level": level or None, "message": "|".join(message) or None, "source": source or None, "is_anomaly": int(flag)}


@query("own_format", _ROWS)
def own_format(spark, sf_dir):
    """Rows written by a format of one's own and read back by a parser of one's own, as a table function in SQL."""
    path = shared_dir(spark, "piped")
    register_format(spark, _Pipes())
    _selected(views.scored_logs(spark, sf_dir)).write.format("piped").mode("append").save(path)
    register_parser(spark, "piped_fields", _PipedLines())
    lines = spark.read.text(path)
    return spark.sql("SELECT f.* FROM {lines}, LATERAL piped_fields(value) AS f", lines=lines)

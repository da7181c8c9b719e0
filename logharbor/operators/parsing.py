"""Turn lines of text into a typed log table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logharbor import constants as K
from logharbor.config import ConfigError, ParserConfig
from logharbor.functions.text import UNICODE, stripped

_MARK = "\x01"
_MAX_PATTERN_LENGTH = 500


@dataclass(frozen=True)
class LinePattern:
    """A regular expression with positional groups and the names they carry."""

    regex: str
    fields: tuple[tuple[str, int], ...]

    @property
    def names(self) -> set[str]:
        return {name for name, _ in self.fields}

    def whole_line(self) -> str:
        """The expression extended to the whole line, leftmost match first."""
        flags = UNICODE if self.regex.startswith(UNICODE) else ""
        body = self.regex[len(flags):]
        return rf"{flags}\A(?s:.*?)(?:{body})(?s:.*)\z"


def compile_pattern(pattern: str, unicode_classes: bool = True) -> LinePattern:
    """Check a pattern with named groups and give it positional ones."""
    if len(pattern) > _MAX_PATTERN_LENGTH:
        raise ConfigError(f"pattern longer than {_MAX_PATTERN_LENGTH} characters")
    try:
        index = re.compile(pattern).groupindex
    except re.error as exc:
        raise ConfigError(f"invalid pattern {pattern!r}: {exc}") from exc
    positional = re.sub(r"\(\?P<\w+>", "(", pattern)
    positional = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{index[m.group(1)]}", positional)
    prefix = UNICODE if unicode_classes else ""
    return LinePattern(prefix + positional, tuple(index.items()))


class LogParser:
    """Applies the patterns of a configuration; the first one that matches wins."""

    def __init__(self, config: ParserConfig | dict | None = None) -> None:
        if config is None:
            config = ParserConfig()
        elif not isinstance(config, ParserConfig):
            config = ParserConfig.from_dict(config)
        self.config = config
        self.patterns = [compile_pattern(p, config.unicode_classes) for p in config.patterns]

    def supported_fields(self) -> list[str]:
        names = set(K.STANDARD_FIELDS)
        for pattern in self.patterns:
            names |= pattern.names
        return sorted(names)

    def extra_fields(self) -> list[str]:
        return [f for f in self.supported_fields() if f not in K.STANDARD_FIELDS]

    def parse(self, lines: DataFrame, column: str = "line") -> DataFrame:
        """Rows with ``source``, ``line_number`` and a text column become log rows.

        No line but blank ones is lost: lines that match nothing get level ``UNPARSED``.
        """
        rows = lines.withColumn(column, stripped(F.col(column))).where(F.col(column) != "")
        text = F.col(column)
        plain = ~text.contains(_MARK)
        for i, pattern in enumerate(self.patterns):
            groups = "".join(f"{_MARK}${position}" for _, position in pattern.fields)
            marked = F.regexp_replace(text, pattern.whole_line(), groups or _MARK)
            tried_before = [F.col(f"_m{j}").startswith(_MARK) for j in range(i)]
            pending = plain
            for hit in tried_before:
                pending = pending & ~hit
            rows = rows.withColumn(f"_m{i}", F.coalesce(F.when(pending, marked), F.lit("")))
        parts, which = self._parts(text, plain)
        rows = rows.withColumn("_which", which).withColumn("_parts", parts)
        record = F.struct(
            self._field("timestamp", text, F.lit(None)).alias("timestamp_raw"),
            self._field("level", text, F.lit(K.LEVEL_NO_GROUP)).alias("level"),
            self._field("message", text, text).alias("message"),
            *[self._field(f, text, F.lit(None)).alias(f) for f in self.extra_fields()],
        )
        # One generated row per line. A filter on a parsed field stays above the generator
        # instead of being pushed below, where it would repeat all pattern matching.
        rows = rows.select(
            *[c for c in lines.columns if c != column], F.inline(F.array(record))
        )
        stamp = parsed_timestamp(F.col("timestamp_raw"), self.config.timestamp_formats)
        return rows.withColumn("timestamp", stamp)

    def _parts(self, text: Column, plain: Column) -> tuple[Column, Column]:
        """Captured groups (from index 1) and the number of the winning pattern."""
        empty = F.lit(None).cast("array<string>")
        parts, which = empty, F.lit(None).cast("int")
        for i in reversed(range(len(self.patterns))):
            pattern = self.patterns[i]
            fast_hit = plain & F.col(f"_m{i}").startswith(_MARK)
            slow_hit = ~plain & text.rlike(pattern.regex)
            slow = F.array(
                F.lit(""), *[F.regexp_extract(text, pattern.regex, p) for _, p in pattern.fields]
            )
            parts = (
                F.when(fast_hit, F.split(F.col(f"_m{i}"), _MARK)).when(slow_hit, slow).otherwise(parts)
            )
            which = F.when(fast_hit | slow_hit, F.lit(i)).otherwise(which)
        return parts, which

    def _field(self, name: str, text: Column, default: Column) -> Column:
        """A captured group, the default if the pattern lacks it, or the no-match value."""
        unmatched = {"level": F.lit(K.LEVEL_NO_MATCH), "message": text}.get(name, F.lit(None))
        result = F.when(F.col("_which").isNull(), unmatched.cast("string"))
        for i, pattern in enumerate(self.patterns):
            place = [n for n, _ in pattern.fields].index(name) + 1 if name in pattern.names else None
            value = default if place is None else F.nullif(F.get("_parts", F.lit(place)), F.lit(""))
            result = result.when(F.col("_which") == i, value.cast("string"))
        return result


def parsed_timestamp(raw: Column, formats: tuple[str, ...] = ()) -> Column:
    """Text to a timestamp without zone; what cannot be read becomes null.

    Without explicit formats, ISO dates with ``-`` or ``/`` are understood.
    """
    if not formats:
        return F.translate(raw, "/", "-").try_cast("timestamp_ntz")
    tries = [F.try_to_timestamp(raw, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def parse_access_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """Combined web-server log lines; lines of another shape are left out."""
    pattern = compile_pattern(K.ACCESS_LOG_PATTERN, unicode_classes=False)
    places = {name: i + 1 for i, (name, _) in enumerate(pattern.fields)}
    groups = "".join(f"{_MARK}${position}" for _, position in pattern.fields)
    text = F.replace(stripped(F.col(column)), F.lit(_MARK), F.lit(""))
    split = F.split(F.col("_m"), _MARK)
    status = F.col("status_code")
    rows = (
        lines.withColumn("_m", F.regexp_replace(text, pattern.whole_line(), groups))
        .where(F.col("_m").startswith(_MARK))
        .withColumn("_p", split)
    )
    for name in ("ip_address", "http_method", "url", "referrer", "user_agent", "timestamp"):
        rows = rows.withColumn(name, F.get("_p", F.lit(places[name])))
    when = F.try_to_timestamp(F.col("timestamp"), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    size = F.get("_p", F.lit(places["size"]))
    rows = (
        rows.withColumn("status_code", F.get("_p", F.lit(places["status"])).try_cast("int"))
        .withColumn("response_size", F.when(size == "-", F.lit(0)).otherwise(size.try_cast("bigint")))
        .withColumn("timestamp", F.to_utc_timestamp(when, F.current_timezone()).cast("timestamp_ntz"))
        .withColumn(
            "level",
            F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO"),
        )
        .withColumn("message", F.format_string("%s %s - %d", "http_method", "url", "status_code"))
    )
    return rows.drop("_m", "_p", column)


def pattern_rates(
    lines: DataFrame, patterns: dict[str, str], first: int = 100, column: str = "line"
) -> DataFrame:
    """Share of the first non-blank lines of each source that every pattern matches.

    The rank filter is a per-source top-k: every map task keeps at most ``first`` lines
    of a source before anything is shuffled.
    """
    from pyspark.sql import Window as W

    rows = lines.withColumn(column, stripped(F.col(column))).where(F.col(column) != "")
    rank = F.row_number().over(W.partitionBy("source").orderBy("line_number"))
    top = rows.withColumn("_rank", rank).where(F.col("_rank") <= first)
    hits = [
        F.struct(
            F.lit(name).alias("pattern"),
            F.col(column).rlike(compile_pattern(p).regex).alias("hit"),
        )
        for name, p in patterns.items()
    ]
    return (
        top.select("source", F.explode(F.array(*hits)).alias("h"))
        .groupBy("source", F.col("h.pattern").alias("pattern"))
        .agg(
            F.count(F.lit(1)).alias("lines_checked"),
            F.count_if("h.hit").alias("lines_matched"),
            F.avg(F.col("h.hit").cast("int")).alias("match_rate"),
        )
    )


def sniff_formats(
    lines: DataFrame, patterns: dict[str, str], first: int = 100, least: float = 0.5
) -> DataFrame:
    """The best fitting pattern of each source, if it fits at least ``least`` of the lines; of
    equally good ones the first by name."""
    rates = pattern_rates(lines, patterns, first).where(F.col("match_rate") >= least)
    order = F.struct(-F.col("match_rate"), -F.col("lines_matched"), F.col("pattern"))
    return rates.groupBy("source").agg(
        F.min_by("pattern", order).alias("pattern"), F.max("match_rate").alias("match_rate")
    )


def validity_counts(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per check: rows looked at and rows that satisfy the rule.

    ``checks`` maps a name to (rule, column expression).
    """
    from logharbor.functions.text import is_valid

    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(is_valid(expr, rule)).alias(name) for name, (rule, expr) in checks.items()],
    )
    rows = [
        F.struct(F.lit(name).alias("rule"), F.col("_n").alias("rows_checked"), F.col(name).alias("rows_valid"))
        for name in checks
    ]
    return counts.select(F.inline(F.array(*rows)))

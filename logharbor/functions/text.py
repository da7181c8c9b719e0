"""Column expressions on message text."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from logharbor import constants as K

# Java's predefined classes are ASCII unless this flag is set; log text need not be.
UNICODE = "(?U)"

# Everything str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used and wherever
    the optimizer moves the expression."""
    return F.transform(F.array(value), use)[0]


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return functools.reduce(operator.or_, [text.contains(w) for w in words])


def char_length(message: Column) -> Column:
    return F.length(F.coalesce(message, F.lit(""))).cast("bigint")


def word_count(message: Column) -> Column:
    return F.regexp_count(message, F.lit(UNICODE + r"\S+")).cast("bigint")


def distinct_chars(message: Column) -> Column:
    """Number of different characters."""
    chars = F.filter(F.split(message, ""), lambda c: c != "")
    return F.size(F.array_distinct(chars)).cast("bigint")


def complexity(message: Column) -> Column:
    text = F.coalesce(message, F.lit(""))
    return F.when(text == "", F.lit(0.0)).otherwise(distinct_chars(text) / F.length(text))


def special_char_ratio(message: Column, missing: float = 0.1) -> Column:
    others = F.length(F.regexp_replace(message, r"[\p{L}\p{N}]", ""))
    return F.coalesce(others / F.greatest(F.length(message), F.lit(1)), F.lit(missing))


def flag(message: Column, name: str) -> Column:
    found = F.coalesce(message, F.lit("")).rlike(UNICODE + K.FLAG_PATTERNS[name])
    return found.cast("int")


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a fixed word."""
    shorter = F.length(F.replace(text, F.lit(word), F.lit("")))
    return ((F.length(text) - shorter) / F.lit(len(word))).cast("bigint")


def template(message: Column) -> Column:
    """Lower-cased message with variable parts replaced by placeholders."""
    text = F.lower(F.coalesce(message, F.lit("")))
    for pattern, replacement in K.TEMPLATE_STEPS:
        text = F.regexp_replace(text, UNICODE + pattern, replacement)
    return stripped(text)


def words(text: Column) -> Column:
    return F.filter(F.split(stripped(text), UNICODE + r"\s+"), lambda w: w != "")


def event_type(message: Column) -> Column:
    lowered = F.lower(F.coalesce(message, F.lit("")))
    result = None
    for name, keywords in K.EVENT_TYPE_KEYWORDS:
        found = contains_any(lowered, keywords)
        result = F.when(found, name) if result is None else result.when(found, name)
    return result.otherwise(F.lit(K.EVENT_TYPE_DEFAULT))


def sanitized(message: Column) -> Column:
    """Cut over-long messages, drop control characters, use LF as the only line end."""
    cut = F.when(
        F.length(message) > K.MAX_MESSAGE_LENGTH,
        F.concat(F.substring(message, 1, K.MAX_MESSAGE_LENGTH), F.lit(K.TRUNCATION_MARK)),
    ).otherwise(message)
    clean = F.regexp_replace(cut, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.regexp_replace(clean, "\r\n|\r", "\n")


def is_valid(text: Column, rule: str) -> Column:
    return F.coalesce(text.rlike(K.VALIDITY_PATTERNS[rule]), F.lit(False))


def severity(level: Column, scheme: str) -> Column:
    values, upper, default = K.SEVERITY_MAPS[scheme]
    key = F.upper(level) if upper else level
    result = None
    for name, score in values.items():
        result = F.when(key == name, score) if result is None else result.when(key == name, score)
    return result.otherwise(F.lit(default).cast("int")).cast("bigint")

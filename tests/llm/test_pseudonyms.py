"""Pseudonyms: round trip, form, links between documents."""

from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

from logharbor.llm import pseudonyms

VALUES = {
    "card": ["4735320085237796", "4566 0956 5849 6433", "378282246310005", "6011-1111-1111-1117"],
    "phone": ["+1 (977) 555-0277", "+49 30 1234567", "+441632960961"],
    "email": ["ikaoo.00@mail7.example.com", "A@b.de", "x_y+z%1@sub.dom-ain.org"],
    "address": ["80.215.226.154", "0.0.0.0", "255.255.255.255"],
    "date": ["1999-12-31", "2024-02-29", "1900-01-01", "2099-12-31"],
    "social": ["078-05-1120", "665-01-0001", "899-99-9999"],
    "iban": ["DE89370400440532013000", "ES9121000418450200051332"],
}
INVALID = ["4735320085237795", "1999-13-01", "2023-02-29", "300.1.1.1", "000-12-3456", "DE88370400440532013000", "12345", "v1.2.3.4.5", "0000000000000000"]


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind, value):
    digits = re.sub(r"\D", "", value)
    if kind == "card":
        return _luhn(digits)
    if kind == "date":
        return 1900 <= datetime.date.fromisoformat(value).year <= 2099
    if kind == "address":
        return all(0 <= int(p) <= 255 for p in value.split("."))
    if kind == "iban":
        return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1
    if kind == "social":
        return value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000"
    return True


@pytest.fixture(scope="module")
def docs(spark):
    every = [v for values in VALUES.values() for v in values]
    rows = [(i, f"Ünd {v} then {every[(i + 7) % len(every)]}, {v}.") for i, v in enumerate(every)]
    rows += [(100 + i, f"left {v} right") for i, v in enumerate(INVALID)]
    rows += [(200, None), (201, ""), (202, "no value here"), (203, "a " * 5000 + every[0]), (203, "a " * 5000 + every[0]), (None, every[0])]
    return spark.createDataFrame([(i, t, 3, "k") for i, t in rows], "doc_id long, text string, found int, values string")


def test_values_are_found_and_keep_their_form(docs):
    rows = {r["doc_id"]: r for r in pseudonyms.with_pseudonyms(docs, "key").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    seen = {}
    number = 0
    for kind, values in VALUES.items():
        for value in values:
            row = rows[number]
            kinds = [x["kind"] for x in row["found"]]
            assert len(kinds) == 3 and kinds[0] == kinds[2] == kind, (value, row)
            for x in row["found"]:
                old = texts[number][x["start"] : x["start"] + x["length"]]
                new = row["text"][x["start"] : x["start"] + x["length"]]
                assert new == x["pseudonym"] and re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub(
                    r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", old))
                )
                assert _valid(x["kind"], new), (old, new)
                assert seen.setdefault(old, new) == new  # equal values stay linked
            number += 1
    assert len(set(seen.values())) == len(seen)
    assert sum(old != new for old, new in seen.items()) >= len(seen) - 2
    for i, value in enumerate(INVALID):
        assert rows[100 + i]["text"] == f"left {value} right" and rows[100 + i]["found"] == []
    assert rows[200]["text"] == rows[201]["text"] == "" and rows[202]["text"] == "no value here"
    assert pseudonyms.with_pseudonyms(docs, "key").count() == docs.count()


def test_round_trip(docs):
    there = pseudonyms.with_pseudonyms(docs, "key")
    back = pseudonyms.with_pseudonyms(there, "key", back=True)
    assert sorted(back.select(F.coalesce("doc_id", F.lit(-1)), "text").collect()) == sorted(
        docs.select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))).collect()
    )


def test_another_key_gives_others(docs):
    one = {tuple(r) for r in pseudonyms.with_pseudonyms(docs, "key").select("doc_id", "text").collect()}
    two = {tuple(r) for r in pseudonyms.with_pseudonyms(docs, "other").select("doc_id", "text").collect()}
    assert len(one & two) < 15


def test_permutation_of_a_whole_set(spark):
    for size in (10, 97, 73_049, 1000):
        numbers = spark.range(size).select(pseudonyms.permuted(F.col("id"), size, "k", "t").alias("n")) if size < 5000 else None
        if numbers is not None:
            assert sorted(r["n"] for r in numbers.collect()) == list(range(size))
    three = spark.range(1000).select(pseudonyms.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("n"))
    assert len({r["n"] for r in three.collect()}) == 1000


def test_no_python_in_the_plan(docs):
    plan = pseudonyms.with_pseudonyms(docs.select("*"), "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_other_written_forms(spark):
    forms = {
        "iban": ["GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300", "FR1420041010050500013M02606", "BE68 5390 0754 7034", "BE68539007547034"],
        "card": ["3782 822463 10005", "3782-822463-10005"],
        "phone": ["(555) 123-4567", "555-123-4567", "+1 555 123 4567", "+49 30 1234567", "+49301234567"],
    }
    rows = [(f"{kind} {v}", f"see {v} IN TIME") for kind, values in forms.items() for v in values]
    there = pseudonyms.with_pseudonyms(spark.createDataFrame(rows, "doc_id string, text string"), "key")
    found = {r["doc_id"]: r["found"] for r in there.collect()}
    new = {}
    for kind, values in forms.items():
        for v in values:
            (x,) = found[f"{kind} {v}"]
            new[v] = x["pseudonym"]
            shape = [re.sub("[A-Z]", "A", re.sub(r"\d", "9", t)) for t in (v, new[v])]
            assert x["kind"] == kind and x["start"] == 4 and new[v] != v and shape[0] == shape[1]
            assert kind == "phone" or _valid(kind, new[v].replace(" ", ""))
    plain = {v: re.sub("[^A-Z0-9]", "", t) for v, t in new.items()}
    assert plain["BE68 5390 0754 7034"] == plain["BE68539007547034"] and plain["+49 30 1234567"] == plain["+49301234567"]
    assert plain["(555) 123-4567"] == plain["555-123-4567"] == plain["+1 555 123 4567"][1:]
    back = pseudonyms.with_pseudonyms(there, "key", back=True)
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == set(rows)

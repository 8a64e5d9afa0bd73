import hashlib
import hmac
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from lexspan.functions import text as T
from lexspan.functions.sentences import spans_of


def value(spark, column, **row):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'date' if isinstance(v, date) else 'double' if isinstance(v, float) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text, number", [("(1,094)", -1094.0), ("11%", 11.0), ("—", None), ("$ 2.5", 2.5), ("-3", -3.0), ("abc", None), ("", None), (None, None)])
def test_parse_number(spark, text, number):
    assert value(spark, T.parse_number("t"), t=text) == number


@pytest.mark.parametrize("text, ok", [("1,094", True), ("(12.5)%", True), ("$", True), ("–", True), ("Net sales", False), ("", False), (None, False)])
def test_numeric_cell(spark, text, ok):
    assert value(spark, T.is_numeric_cell("t"), t=text) is ok


def test_slug_hash_space(spark):
    assert value(spark, T.slugify("t"), t="R&D’s  Costs!") == "r-and-ds-costs"
    assert value(spark, T.slugify("t"), t="!!") == "x"
    assert value(spark, T.normalize_space("t"), t=" a  b\n") == "a b"
    assert value(spark, T.short_hash("t"), t="a") == hashlib.sha256(b"a").hexdigest()[:8]


def test_numbers(spark):
    assert value(spark, T.numbers_in_text("t"), t="up 11% to $1,234.50 (12) in v2.0") == ["11", "12", "1234.5"]
    assert value(spark, T.normalize_number(F.col("n")), n=0.125) == "0.12"


@pytest.mark.parametrize("number", [12345678901234567890.0, 1e23, 1e308, 2.0**63, 2.0**53 - 1, 1234567890123456.785, 2.0**43 + 0.995])
def test_large_numbers_have_all_digits(spark, number):
    assert value(spark, T.normalize_number(F.col("n")), n=number) == f"{number:.2f}".rstrip("0").rstrip(".")


def test_numbers_side_by_side(spark):
    assert value(spark, T.numbers_in_text("t"), t="(030)1234 5%7") == ["1234", "30", "5", "7"]
    assert value(spark, T.numbers_in_text("t", apart=True), t="(030)1234 5%7") == ["30", "5"]


def test_query_tokens_keep_repeats(spark):
    assert value(spark, T.query_tokens("t"), t="What was iPhone revenue revenue in June 2026 fiscal?") == ["iphone", "revenue", "revenue"]


def test_quote_gate(spark):
    assert value(spark, T.quote_in_chunk("q", "c"), q="sales of $1,000", c="Net sales of  1000 rose")
    assert not value(spark, T.quote_in_chunk("q", "c"), q=" ", c="x")
    assert not value(spark, T.numbers_supported("q", "c"), q="it was 12", c="it was 13")


@pytest.mark.parametrize("day, quarter", [(date(2025, 12, 27), "2025-Q4"), (date(2027, 1, 1), "2026-Q4"), (date(2026, 6, 27), "2026-Q2")])
def test_calendar_quarter(spark, day, quarter):
    assert value(spark, T.calendar_quarter("d"), d=day) == quarter


def test_ids(spark):
    assert value(spark, T.uuid5("t"), t="a#1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "a#1"))
    assert value(spark, T.hmac_sha256("key", F.col("t")), t="msg") == hmac.new(b"key", b"msg", hashlib.sha256).hexdigest()
    assert value(spark, T.path_slug("p"), p=["Part I", "Item 1.", "Net Sales", "By Area"]) == "net-sales--by-area"
    assert value(spark, T.path_slug("p"), p=["Part I"]) == "item"


def test_issuer_guard(spark):
    assert value(spark, T.out_of_corpus_issuer("t"), t="Tesla revenue?")
    assert not value(spark, T.out_of_corpus_issuer("t"), t="Apple against Tesla?")
    assert not value(spark, T.out_of_corpus_issuer("t"), t=None)


def test_sentences():
    text = "U.S. sales rose. Costs fell 3.5% overall. ok"
    assert [text[a:b] for a, b in spans_of(text)] == ["U.S. sales rose.", "Costs fell 3.5% overall. ok"]


def test_related_paths(spark):
    rel = T.are_related(F.col("a"), F.col("b"))
    assert value(spark, rel, a=["P", "I", "Sub a"], b=["P", "I", "Sub b"])
    assert not value(spark, rel, a=["P", "I", "Note 1 – Cash"], b=["P", "I", "Note 2 – Debt"])

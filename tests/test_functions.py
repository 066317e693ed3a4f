import math

import pytest
from pyspark.sql import functions as F

from threadloom.functions import scalars as S
from threadloom.sources import readers


def one(spark, column, **values):
    kind = lambda v: "string" if isinstance(v, str) or v is None else "double" if isinstance(v, float) else "long"
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "host"),
    [
        ("https://www.a.org/x?y=1#z", "a.org"), ("http://a.org:8080/x", "a.org"), ("http://h?x=1", "h?x=1"), ("ftp://a.org/x", ""),
        ("http://a b/x", ""), ("", ""), (None, ""), ("https://sub.www.a.org", "sub.www.a.org"),
    ],
)
def test_host(spark, url, host):
    assert one(spark, S.host_of(F.col("u")), u=url) == host


@pytest.mark.parametrize(
    ("date", "at"),
    [
        ("2020-05-01T10:00:00+03:00", 1588316400), ("2020-05-01T10:00:00-05:30", 1588347000), ("1969-12-31T23:00:00+00:00", 0),
        ("2020-05-01T10:00:00Z", None), ("2020-13-01T10:00:00+00:00", None), ("", None), (None, None),
    ],
)
def test_dates(spark, date, at):
    assert one(spark, S.iso_to_epoch(F.col("d")), d=date) == at
    if at:
        assert readers.parse_date(date) == at


@pytest.mark.parametrize(
    ("title", "lang", "bad"),
    [
        ("a b cdefghijklm", "en", True), ("a b cdefghijklmn", "en", False), ("я " * 7 + "я", "ru", True), ("слово ещё слово и", "ru", False),
        ("One two three four five!", "en", True), ("One two three four five ", "en", True), ('"One two three four', "en", True),
        ("«Один два три четыре", "ru", False), ("Onlyoneblank inthistitle", "en", True), ("Two blanks in this", "en", False),
    ],
)
def test_nasty(spark, title, lang, bad):
    assert one(spark, S.nasty(F.col("t"), F.col("l")), t=title, l=lang) is bad


@pytest.mark.parametrize(("title", "exact"), [("plain", False), ("Привет", False), ("ёё", True), ("aaaaé", False), ("日本語", True), ("", False), ("ab🙂", False)])
def test_unknown_symbols_by_bytes(spark, title, exact):
    got = spark.createDataFrame([(title,)], "t string").select(S.unknown_symbols_bytes("t").alias("x")).first()["x"]
    assert got is exact


def test_sigmoid_never_overflows(spark):
    assert one(spark, S.sigmoid(F.col("v")), v=-800.0) == 0.0
    assert one(spark, S.sigmoid(F.col("v")), v=800.0) == 1.0
    assert one(spark, S.sigmoid(F.col("v")), v=0.5) == pytest.approx(1 / (1 + math.exp(-0.5)))


def test_age_penalty_at_the_edge(spark):
    at = lambda best: one(spark, S.age_penalty(F.col("b"), F.lit(100000), F.lit(28800)), b=best)
    assert at(71200) == 1.0
    assert at(71199) == pytest.approx(1 / (1 + math.exp(-8)), abs=1e-6)


@pytest.mark.parametrize(("header", "ttl"), [("max-age=60", 60), ("no-cache", -1), ("xxxxxxxx5", 5), ("max-age=", None), ("max-age=x", None), (None, None)])
def test_ttl(spark, header, ttl):
    assert one(spark, S.ttl_seconds(F.col("h")), h=header) == ttl


def test_traffic_score_floor_and_kinds(spark):
    score = lambda kind, raw, us, shift: one(spark, S.traffic_score(F.lit(kind), F.col("raw"), F.col("us"), F.lit(0.0), F.lit(0.0), F.lit(shift)), raw=raw, us=us)
    assert score("one", 5.0, 10.0, 0.0) == 1.0
    assert score("raw", 5.0, 10.0, 0.0) == pytest.approx(4.5)
    assert score("log", 0.1, 0.0, 1.0) == 0.3
    assert score("log", 5.0, 500.0, 1.0) == 0.3


def test_categories(spark):
    assert one(spark, S.category_ordinal(F.col("c")), c="weather") == 0
    assert one(spark, S.category_ordinal(F.col("c")), c=None) == 0
    assert one(spark, S.category_name(S.category_ordinal(F.col("c"))), c="science") == "science"


def test_shrink_counts_by_paragraph(spark):
    rows = spark.createDataFrame([(["a b c", "d e", "f"],)], "p array<string>")
    assert rows.select(S.shrink(F.col("p"), 4).alias("x")).first()["x"] == "a b c\nd e\n"

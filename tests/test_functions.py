"""Scalar rules, value by value."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import display as d
from shelfspark.functions import loans as l
from shelfspark.functions import text as t
from shelfspark.operators.ledger import micros, timestamp
from shelfspark.operators.search import search


def values(spark, inputs, kind, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [row.out for row in df.select("i", rule(F.col("v")).alias("out")).orderBy("i").collect()]


def test_clean_int(spark):
    cases = {
        "12abc": 12, "-5": 0, "abc": 0, "": 0, " 7": 7, "\t+8": 8, "1e3": 1000, "1.9": 1,
        "2.5e1x": 25, "-1e3": 0, ".5": 0, "e5": 0, "1e999": 0, "99999999999": 99999999999,
        "99999999999999999999": 2**63 - 1, "-99999999999999999999": 0, None: 0, "3 4": 3,
    }
    assert values(spark, list(cases), "string", t.clean_int) == list(cases.values())


def test_clean_text(spark):
    inputs = ["\t x \r\n", "\0a\x0b", "a b", None, " x"]
    assert values(spark, inputs, "string", t.clean_text) == ["x", "a", "a b", "", " x"]


def test_hash_and_null(spark):
    assert values(spark, ["abc", None], "string", t.md5_hex) == [
        "900150983cd24fb0d6963f7d28e17f72", "d41d8cd98f00b204e9800998ecf8427e"
    ]
    assert values(spark, [0, 3, None], "int", t.zero_to_null) == [None, 3, None]


def test_days_rules(spark):
    days = [-3, 0, 1, 2, 3, 7, 9]
    assert values(spark, days, "int", d.days_text) == [
        "3d late", "0d left", "1d left", "2d left", "3d left", "7d left", "9d left"
    ]
    assert values(spark, days, "int", d.due_band) == ["late", "soon", "soon", "soon", "ok", "ok", "ok"]
    assert values(spark, days, "int", d.time_bar) == pytest.approx(
        [0, 0, 100 / 7, 200 / 7, 300 / 7, 100, 100]
    )
    assert values(spark, [0, 2, -1], "int", d.due_soon_text) == ["TODAY", "in 2d", "in -1d"]
    assert values(spark, days, "int", lambda n: d.member_due_text(F.lit("active"), n)) == [
        "Due in -3d", "Due today!", "Due in 1d", "Due in 2d", None, None, None
    ]
    assert values(spark, [-3, 4], "int", lambda n: d.member_due_text(F.lit("overdue"), n)) == [
        "3d overdue", "4d overdue"
    ]


def test_stock_and_names(spark):
    assert values(spark, [0, 2], "int", d.stock_text) == ["Out of stock", "2 left"]
    assert values(spark, [0, 2], "int", d.stock_badge) == ["out", "in"]
    assert values(spark, [0, 2], "int", lambda q: d.action_text(F.lit(False), q)) == ["Unavailable", "Borrow"]
    assert values(spark, [0], "int", lambda q: d.action_text(F.lit(True), q)) == ["Borrowed"]
    assert values(spark, ["a", "", "0", None], "string", d.genre_cell) == ["a", "—", "—", "—"]
    assert values(spark, ["a", "", None], "string", d.legacy_genre_cell) == ["a", "", "—"]
    assert values(spark, ["active"], "string", d.status_text) == ["Active"]


def test_due_date_and_clock(spark):
    at = dt.datetime(2024, 2, 26, 23, 59, 59)
    assert values(spark, [at], "timestamp_ntz", l.due_date) == [dt.date(2024, 3, 4)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_show_as_stored_in_any_zone(spark, zone):
    times = [dt.datetime(2024, 3, 10, 2, 5), dt.datetime(2024, 12, 1, 23, 59)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert values(spark, times, "timestamp_ntz", d.minute_text) == [
            "Mar 10, 2024 02:05", "Dec 01, 2024 23:59"
        ]
        assert values(spark, times, "timestamp_ntz", d.day_text) == ["Mar 10, 2024", "Dec 01, 2024"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_microseconds_survive_any_zone(spark, zone):
    times = [
        dt.datetime(2024, 3, 10, 2, 30, 0, 123456),  # does not exist in New York
        dt.datetime(1969, 12, 31, 23, 59, 59, 999999),
        dt.datetime(2400, 1, 1),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert values(spark, times, "timestamp_ntz", lambda c: timestamp(micros(c))) == times
        exact = [(x - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for x in times]
        assert values(spark, times, "timestamp_ntz", micros) == exact
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    "query, found",
    [
        ("", [1, 2, 3]),
        (" ", [1, 2, 3]),
        ("50%_x", [1]),
        ("%", [1]),
        ("_", [1]),
        ("ÉCOLE", [2]),
        ("red blue", []),
        ("red", [3]),
        (" blue", [3]),
    ],
)
def test_search_is_literal_and_stays_in_cells(spark, query, found):
    df = spark.createDataFrame([(1, "a 50%_x", "b"), (2, "École", None), (3, "red", "Blue")], "id int, a string, b string")
    assert [row.id for row in search(df, [F.col("a"), F.col("b")], query).orderBy("id").collect()] == found

"""Snapshots that take changes, and requests read from what a browser sends."""

import datetime as dt
import os
import urllib.parse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.functions import forms
from shelfspark.operators import ledger, search, search_index
from shelfspark.plans import reports
from shelfspark.schema import BOOKS, BORROWS, GENRES, LEDGER_REQUEST, TABLES, USERS
from shelfspark.session import work_folder
from shelfspark.sources import changes
from shelfspark.sources.seed import starter_tables
from shelfspark.tables import Tables

NOON = dt.datetime(2026, 5, 1, 12)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files_of(folder):
    root = folder.removeprefix("file://").removeprefix("file:")
    return {os.path.join(d, name) for d, _, names in os.walk(root) for name in names if name.endswith(".parquet")}


def history(spark):
    """Loans of four months; each month's first is out, the others are back."""
    loans = []
    for i in range(40):
        taken = dt.datetime(2026, 1 + i // 10, 3 + i % 10, 9)
        out = i % 10 == 0
        loans.append((i + 1, 1 + i % 5, 1 + i % 4, taken, taken.date() + dt.timedelta(7), None if out else taken + dt.timedelta(2), "active" if out else "returned"))
    books = [(b, f"B{b}", "", 3, None, NOON) for b in (1, 2, 3, 4, changes.BOOK_KEYS + 1)]
    return Tables(
        books=spark.createDataFrame(books, BOOKS), borrows=spark.createDataFrame(loans, BORROWS), genres=spark.createDataFrame([(1, "a")], GENRES), users=spark.createDataFrame([(u, f"u{u}", "", "user", NOON) for u in range(1, 6)], USERS)
    )


def test_a_replay_rewrites_what_it_touched(spark):
    home = work_folder(spark)
    changes.write_ranges(history(spark), home)
    before = changes.read_ranges(spark, home)
    assert {name: rows(getattr(before, name)) for name in TABLES} == {name: rows(getattr(history(spark), name)) for name in TABLES}
    # Loan 11 of February comes back, so no active loan is left there; a new loan is taken in May and one taken and returned in June.
    moves = [
        (0, dt.datetime(2026, 5, 2), 1, "return", None, 11), (1, dt.datetime(2026, 5, 3), 2, "borrow", 4, None),
        (2, dt.datetime(2026, 6, 3), 3, "borrow", changes.BOOK_KEYS + 1, None), (3, dt.datetime(2026, 6, 4), 3, "return", changes.BOOK_KEYS + 1, None),
    ]
    played = ledger.replay(before, spark.createDataFrame(moves, LEDGER_REQUEST))
    want = {name: rows(getattr(played.tables, name)) for name in TABLES}
    there = files_of(home)
    touched = changes.apply_replay(before, played, home)
    assert touched == {"borrows": [("active", "2026-02"), ("active", "2026-05"), ("returned", "2026-02"), ("returned", "2026-06")], "books": [(0,)]}
    after = changes.read_ranges(spark, home)
    assert {name: rows(getattr(after, name)) for name in TABLES} == want
    assert {r.tbl: r.next_id for r in after.counters.collect()}["borrows"] == 45
    # Partitions it did not touch keep their files.
    kept = there & files_of(home)
    for part in ("status=active/period=2026-01", "status=returned/period=2026-01", "status=returned/period=2026-04", "keys=1"):
        assert {f for f in there if part in f} and {f for f in there if part in f} <= kept
    assert not any("status=active/period=2026-02" in f for f in files_of(home))
    # And again, on what it left.
    again = ledger.replay(after, spark.createDataFrame([(0, dt.datetime(2026, 7, 1), 2, "return", 4, None)], LEDGER_REQUEST))
    want = {name: rows(getattr(again.tables, name)) for name in TABLES}
    assert changes.apply_replay(after, again, home)["borrows"] == [("active", "2026-05"), ("returned", "2026-05")]
    final = changes.read_ranges(spark, home)
    assert {name: rows(getattr(final, name)) for name in TABLES} == want


def test_a_replay_that_changes_nothing(spark):
    home = work_folder(spark)
    changes.write_ranges(starter_tables(spark), home)
    before = changes.read_ranges(spark, home)
    there = files_of(home)
    nothing = ledger.replay(before, spark.createDataFrame([], LEDGER_REQUEST))
    assert changes.apply_replay(before, nothing, home) == {"borrows": [], "books": []}
    assert {f for f in there if "counters" not in f} <= files_of(home)
    assert rows(changes.read_ranges(spark, home).borrows) == rows(before.borrows)


# --- forms -------------------------------------------------------------------------


def read(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [[tuple(p) for p in r.p] for r in df.select("i", forms.fields(F.col("t")).alias("p")).orderBy("i").collect()]


def test_fields(spark):
    texts = ["a=1&b=2", "a=1&a=2", "a", "a=", "=x", "", None, "&&a=1&", "a=x=y", "a=%41+%C3%A9", "a=%zz", "gen.re=1&gen+re=2", "a%5Fb=c%26d"]
    assert read(spark, texts) == [
        [("a", "1"), ("b", "2")], [("a", "1"), ("a", "2")], [("a", "")], [("a", "")], [("", "x")], [], [], [("a", "1")], [("a", "x=y")], [("a", "A é")], [("a", "%zz")], [("gen_re", "1"), ("gen_re", "2")], [("a_b", "c&d")],
    ]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("abc_", min_size=1, max_size=3), st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=6)), max_size=4), min_size=1, max_size=30))
def test_fields_of_encoded_pairs(spark, forms_):
    assert read(spark, [urllib.parse.urlencode(pairs) for pairs in forms_]) == forms_


RAW = "request_id long, ts timestamp_ntz, user_id long, query string, body string"


def test_catalogue_requests_from_forms(spark):
    sent = [
        (1, "", "add_book=&title=+T%C3%A9&author=A&genre_id=2&quantity=3&quantity=4"),
        (2, None, "edit_book=1&book_id=7&title=x"),
        (3, "delete_book=12abc&page=1", None),
        (4, "delete_genre=3", "add_genre=1&genre_name=New&name=no"),
        (5, "borrow=1", "title=x"),
        (6, None, None),
    ]
    raw = spark.createDataFrame([(i, NOON, 9, q, b) for i, q, b in sent], RAW)
    got = {r.request_id: tuple(r)[3:] for r in forms.catalogue_requests(raw).collect()}
    assert got == {
        5: ("add_book", None, " Té", "A", "2", "4", None),
        11: ("edit_book", "7", "x", None, None, None, None),
        17: ("delete_book", "12abc", None, None, None, None, None),
        23: ("add_genre", None, None, None, None, None, "New"),
        24: ("delete_genre", None, None, None, "3", None, None),
    }


@pytest.mark.parametrize("query, want", [("borrow=4", [(2, "borrow", 4, None)]), ("return_book=9x&borrow=", [(2, "borrow", 0, None), (3, "return", None, 9)]), ("return_book=1&return_book=2", [(3, "return", None, 2)]), ("page=2", [])])
def test_ledger_requests_from_forms(spark, query, want):
    raw = spark.createDataFrame([(1, NOON, 9, query, "borrow=7")], RAW)
    assert sorted((r.request_id, r.kind, r.book_id, r.borrow_id) for r in forms.ledger_requests(raw).collect()) == want


# --- search by trigrams ----------------------------------------------------------------


def test_search_by_trigrams_equals_the_scan(spark):
    words = ["Clean", "Code", "50%_off", "CODE", "Ängste", "ängst", "日本語の本", "a b", "x"]
    shelf = [(i, f"{words[i % 9]} {words[i * 7 % 9]} {i}", words[i % 4] if i % 5 else None, i % 3) for i in range(400)]
    df = spark.createDataFrame(shelf, "id long, title string, author string, n int")
    cells = [F.col("title"), F.col("author"), F.col("n").cast("string")]
    postings = search_index.write_index(df, cells, f"{work_folder(spark)}/postings")
    for query in ("code", "50%_O", "_off", "%", "", "ÄNGST", "日本語", "本語の", "e a", "zzz", "  ", "code 1", "e\n", "Clean Code 0", "38"):
        assert rows(search_index.search_indexed(df, cells, query, postings)) == rows(search.search(df, cells, query)), query
    whole = files_of(f"{os.path.dirname(postings.inputFiles()[0].removeprefix('file://'))}/..")
    read_ = search_index.candidates(postings, "日本語")
    assert rows(read_) and len(read_.inputFiles()) <= len(whole) and search_index.candidates(postings, "ab") is None
    plan = read_._jdf.queryExecution().executedPlan().toString()
    # One bucket of the postings is listed and one gram of it asked for.
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(gram" in plan


def test_browse_for_a_list_of_members(spark):
    snap = starter_tables(spark).at(dt.date(2026, 4, 22))
    got = reports.browse_members(snap, [5, 9, 77, 5]).collect()
    want = [(u, *r) for u in (5, 9, 77) for r in reports.browse(snap, u).collect()]
    assert [tuple(r) for r in got] == [tuple(r) for r in want]

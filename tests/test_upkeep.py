"""Reports kept by changes, answers without a replay, rules in one pass and names by weight, against their plain forms."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.functions import text
from shelfspark.operators import accounts, ample, catalogue, checks, ledger, slices
from shelfspark.plans import reports, upkeep
from shelfspark.schema import BOOK_REQUEST, BOOKS, BORROWS, GENRES, LEDGER_REQUEST, REGISTER_REQUEST, USERS
from shelfspark.tables import Tables
from tests.test_ledger import asked, check, library, one_by_one, traffic

NOON = dt.datetime(2026, 5, 1, 12)
AS_OF = dt.date(2026, 5, 9)


def at(minutes):
    return NOON + dt.timedelta(minutes=minutes)


# --- reports kept up to date ----------------------------------------------------


def shelves(spark, draw):
    books = [(b, f"B{b}", "", draw.randrange(4), draw.choice([None, 1, 2]), NOON) for b in range(1, 9)]
    loans = []
    for i in range(1, 60):
        status = draw.choice(["active", "overdue", "returned", "returned"])
        back = at(i) if (status == "returned") != (draw.random() < 0.1) else None
        loans.append((i, draw.randrange(1, 8), draw.randrange(1, 9), at(draw.randrange(-30, 0) * 720), dt.date(2026, 5, draw.randrange(1, 20)), back, status))
    users = [(u, f"u{u}", "", "admin" if u == 9 else "user", NOON) for u in range(1, 10)]
    return Tables(
        books=spark.createDataFrame(books, BOOKS), borrows=spark.createDataFrame(loans, BORROWS), genres=spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], GENRES), users=spark.createDataFrame(users, USERS)
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_reports(kept, tables):
    assert rows(upkeep.user_stats(kept, tables, AS_OF)) == rows(reports.user_stats(tables.at(AS_OF)))
    assert rows(upkeep.top_books(kept, tables)) == rows(reports.top_books(tables.at(AS_OF)))
    assert rows(upkeep.genre_stats(kept, tables)) == rows(reports.genre_stats(tables.at(AS_OF)))


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_reports_equal_full_ones(spark, seed):
    draw = random.Random(seed)
    before = shelves(spark, draw)
    kept = upkeep.keep(before).written()
    same_reports(kept, before)
    moves = [(i, at(i), draw.randrange(1, 8), draw.choice(["borrow", "return"]), draw.randrange(1, 9), draw.choice([None, None, draw.randrange(1, 60)])) for i in range(60)]
    played = ledger.replay(before, spark.createDataFrame(moves, LEDGER_REQUEST))
    kept = upkeep.updated(kept, played.tables, upkeep.loans_of_replay(before, played)).written()
    same_reports(kept, played.tables)
    gone = [(i, at(i), 9, "delete", str(b), None, None, None, None) for i, b in enumerate(draw.sample(range(1, 9), 3))]
    after = catalogue.delete_books(played.tables, spark.createDataFrame(gone, BOOK_REQUEST)).tables
    kept = upkeep.updated(kept, after, upkeep.loans_of_deletion(played.tables, after), upkeep.books_changed(played.tables, after))
    same_reports(kept, after)


def test_a_latest_date_is_looked_up_again_only_where_it_went(spark):
    """Member 1 loses the latest loan with a book, member 2 an earlier one, member 3 all."""
    loans = [(i, u, b, at(m), AS_OF, at(900), "returned") for i, u, b, m in [(1, 1, 1, 50), (2, 1, 2, 40), (3, 2, 1, 10), (4, 2, 2, 60), (5, 3, 1, 5), (6, 1, 2, 30)]]
    before = Tables(
        books=spark.createDataFrame([(b, "t", "a", 1, None, NOON) for b in (1, 2)], BOOKS), borrows=spark.createDataFrame(loans, BORROWS),
        genres=spark.createDataFrame([], GENRES), users=spark.createDataFrame([(u, f"u{u}", "", "user", NOON) for u in (1, 2, 3)], USERS),
    )
    after = before.replace(books=before.books.where("id = 2"), borrows=before.borrows.where("book_id = 2"))
    # Only member 1's loans are read again: those of others would give a wrong date here.
    trap = after.replace(borrows=after.borrows.withColumn("borrowed_at", F.when(F.col("user_id") == 1, F.col("borrowed_at")).otherwise(F.lit(at(9999)).cast("timestamp_ntz"))))
    kept = upkeep.updated(upkeep.keep(before), trap, upkeep.loans_of_deletion(before, after))
    assert {r.id: (r.total, r.last_borrow) for r in kept.members.collect()} == {1: (2, at(40)), 2: (1, at(60))}
    same_reports(upkeep.updated(upkeep.keep(before), after, upkeep.loans_of_deletion(before, after)), after)


# --- answers without a replay ------------------------------------------------------


def test_ample_books_are_answered_without_python(spark):
    rows = traffic(3, 200, 4, 12)
    loans = [(1000, 1, 1, "active"), (1001, 2, 1, "overdue"), (1002, 3, 2, "active", True), (1003, 4, 2, "returned", False), (1004, 1, 1, "active")]
    rows += [(900, 1000, 2, "return", None, 1001), (901, 1001, 2, "return", None, 1001), (902, 1002, 4, "return", None, 1003), (903, 1003, 3, "return", 2, None), (904, 1, 5, "borrow", 77, None)]
    stock = {b: 500 for b in range(1, 5)}
    check(spark, stock, loans, rows)
    tables = library(spark, stock, loans)
    outcomes = ledger.replay(tables, asked(spark, rows[:200])).outcomes
    plan = ledger.replay(tables, asked(spark, rows[:200]), reuse=False).answers._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and outcomes.count() == 200


@pytest.mark.parametrize("seed", range(4))
def test_fold_and_replay_share_a_batch(spark, seed, monkeypatch):
    """Books with ample stock, contended ones and a busy one side by side; loans are returned by key and by book."""
    draw = random.Random(seed)
    stock = {1: 1000, 2: 0, 3: 2, 4: 30}
    loans = [(500 + i, draw.randrange(1, 12), draw.randrange(1, 5), draw.choice(["active", "overdue", "returned"]), draw.choice([True, False])) for i in range(12)]
    rows = []
    for i in range(160):
        kind = draw.choice(["borrow", "return"])
        named = kind == "return" and draw.random() < 0.5
        rows.append((i, draw.randrange(60), draw.randrange(1, 12), kind, None if named else draw.randrange(1, 5), draw.choice([500 + draw.randrange(12), 512 + draw.randrange(160)]) if named else None))
    folded = []
    fold = ample.fold_members
    monkeypatch.setattr(slices.ample, "fold_members", lambda *a: folded.append(1) or fold(*a))
    want, left, _ = one_by_one(stock, loans, rows, lambda i: 512 + i)
    for size in (1_000_000, 35):
        got = ledger.replay(library(spark, stock, loans), asked(spark, rows), slice_rows=size)
        assert {x.request_id: x.outcome for x in got.outcomes.collect()} == want
        assert {x.id: x.quantity for x in got.tables.books.collect()} == left
    assert folded


# --- all rules in one pass ------------------------------------------------------------


def test_rules_in_one_pass(spark):
    text_, long = "x", "y" * 300
    tables = Tables(
        books=spark.createDataFrame([(1, text_, "a", 1, 1, NOON), (1, long, "a", 1, 9, NOON), (2, None, "a", 1, None, NOON), (None, text_, long, 1, 9, NOON)], "id long, title string, author string, quantity int, genre_id int, created_at timestamp_ntz"),
        genres=spark.createDataFrame([(1, "Art"), (2, "ÁRT "), (3, None)], "id int, name string"),
        users=spark.createDataFrame([(1, "straße", "p", "user", NOON), (2, "STRASE", "p", long, NOON), (2, "z", None, "user", None)], "id long, username string, password string, role string, created_at timestamp_ntz"),
        borrows=spark.createDataFrame(
            [(1, 1, 1, NOON, AS_OF, None, "active"), (2, 1, 1, NOON, AS_OF, None, "overdue"), (3, 1, 1, NOON, AS_OF, None, "returned"), (3, 7, 8, None, AS_OF, None, "lost"), (4, None, 8, NOON, None, None, None)],
            "id long, user_id long, book_id long, borrowed_at timestamp_ntz, due_date date, returned_at timestamp_ntz, status string",
        ),
    )
    want = {name: broken.count() for name, broken in checks.all_violations(tables).items()}
    counted = checks.violation_counts(tables)
    assert {r.rule: r.n for r in counted.collect()} == want
    assert want["foreign_keys"] == 5 and want["genres_unique_name"] == want["users_unique_username"] == want["borrows_open_pairs"] == 1
    empty = Tables(**{name: getattr(tables, name).limit(0) for name in ("books", "genres", "users", "borrows")})
    assert {r.n for r in checks.violation_counts(empty).collect()} == {0}


def test_rules_read_each_table_once(spark, tmp_path):
    from shelfspark.sources import files
    from shelfspark.sources.seed import starter_tables

    files.write_tables(starter_tables(spark), f"file://{tmp_path}/s")
    plan = checks.violation_counts(files.read_tables(spark, f"file://{tmp_path}/s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4


# --- names by weight ---------------------------------------------------------------------


def weights(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    return [r.w for r in df.select(text.ci("n").alias("w")).collect()]


def test_names_of_equal_weight(spark):
    groups = [["Straße", "STRASE", "strasé  "], ["İzmir", "izmir"], ["Œuvre", "œUVRE"], ["Ångström", "angstrom"], ["Ёлка", "елка"], ["a\U0001f600", "A\U0001f4da"], ["ΣΊΣΥΦΟΣ", "σισυφος"], ["", "   "]]
    found = [weights(spark, group) for group in groups]
    assert all(len(set(f)) == 1 for f in found) and len({f[0] for f in found}) == len(groups)
    apart = weights(spark, ["ae", "æ", "o", "ø", "ss", "ß", "é", "é", " a", "a", "a\t", "한", "하"])
    assert len(set(apart)) == len(apart)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F), max_size=6), min_size=1, max_size=30))
def test_weights_are_by_character(spark, names):
    plain, weight = text._weights()
    table = str.maketrans(plain, weight)
    assert weights(spark, names) == [n.translate(table).rstrip(" ") for n in names]
    assert all(len(x) == 1 for x in table.values() if isinstance(x, str))


def test_names_of_equal_weight_are_taken(spark):
    tables = library(spark, {1: 1}).replace(users=spark.createDataFrame([(1, "Groß", "x", "user", NOON)], USERS))
    new = spark.createDataFrame([(1, NOON, "GROS", "p"), (2, NOON, "gross", "p"), (3, NOON, "GROẞ", "p")], REGISTER_REQUEST)
    got = {r.request_id: r.outcome for r in accounts.register_users(tables, new).outcomes.collect()}
    assert got[1] == "taken" and got[2] == "registered"

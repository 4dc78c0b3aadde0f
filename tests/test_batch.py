"""One ordered batch of all catalogue kinds against a serial replay, and the counters that give keys."""

import datetime as dt
import random

import pytest

from shelfspark.operators import accounts, batch, catalogue, ledger
from shelfspark.operators.requests import numbered
from shelfspark.schema import (
    BOOK_REQUEST,
    BOOKS,
    BORROWS,
    CATALOGUE_REQUEST,
    GENRE_REQUEST,
    GENRES,
    LEDGER_REQUEST,
    REGISTER_REQUEST,
    USERS,
)
from shelfspark.session import work_folder
from shelfspark.sources import files
from shelfspark.sources.seed import starter_tables
from shelfspark.tables import Tables

NOON = dt.datetime(2026, 5, 1, 12)
COUNTERS = "tbl string, next_id long"


def at(seconds):
    return NOON + dt.timedelta(seconds=seconds)


def library(spark, books, genres, loans=(), counters=None):
    return Tables(
        books=spark.createDataFrame([(i, f"t{i}", "a", q, g, NOON) for i, q, g in books], BOOKS),
        genres=spark.createDataFrame(genres, GENRES),
        borrows=spark.createDataFrame([(i, 2, b, NOON, NOON.date(), None, status) for i, b, status in loans], BORROWS),
        users=spark.createDataFrame([(1, "root", "x", "admin", NOON), (2, "u", "x", "user", NOON)], USERS),
        counters=spark.createDataFrame(counters, COUNTERS) if counters else None,
    )


def serially(books, genres, loans, counters, asked):
    """Requests one after another on plain dictionaries."""
    shelf = {i: (f"t{i}", "a", g, q, NOON) for i, q, g in books}
    names = dict(genres)
    next_id = {
        "books": max([counters.get("books", 1), *(i + 1 for i in shelf)]),
        "genres": max([counters.get("genres", 1), *(i + 1 for i in names)]),
    }
    loans = list(loans)
    out = {}
    for r, second, user, kind, book, title, author, genre, quantity, name in sorted(asked, key=lambda x: (x[1], x[0])):
        number = lambda text: int(text) if text is not None and text.isdigit() else 0
        book, genre, quantity = number(book), number(genre), number(quantity)
        title, author, name = ((x or "").strip() for x in (title, author, name))
        restored = None
        if user != 1:
            outcome = "forbidden"
        elif kind == "add_genre":
            key = next_id["genres"]
            next_id["genres"] += 1
            if len(name) > 100:
                outcome = "too_long"
            elif any(x.lower() == name.lower() for x in names.values()):
                outcome = "exists"
            else:
                names[key], outcome = name, "added"
        elif kind == "delete_genre":
            outcome = "deleted" if names.pop(genre, None) is not None else "no_such_genre"
            if outcome == "deleted":
                shelf = {i: (t, a, None if g == genre else g, q, c) for i, (t, a, g, q, c) in shelf.items()}
        elif kind in ("add_book", "edit_book"):
            key = next_id["books"]
            next_id["books"] += kind == "add_book"
            genre = genre or None
            if len(title) > 255 or len(author) > 255:
                outcome = "too_long"
            elif quantity > 2**31 - 1:
                outcome = "out_of_range"
            elif genre is not None and genre not in names:
                outcome = "unknown_genre"
            elif kind == "add_book":
                shelf[key], outcome = (title, author, genre, quantity, at(second)), "added"
            elif book in shelf:
                shelf[book], outcome = (title, author, genre, quantity, shelf[book][4]), "updated"
            else:
                outcome = "no_such_book"
        elif kind == "delete_book":
            outcome = "deleted" if book in shelf else "no_such_book"
            if outcome == "deleted":
                restored = shelf.pop(book)[3] + sum(b == book and s in ("active", "overdue") for _, b, s in loans)
                loans = [x for x in loans if x[1] != book]
        else:
            outcome = "unknown_kind"
        out[r] = (outcome, restored)
    return shelf, names, {i for i, _, _ in loans}, next_id, out


def check(spark, books, genres, loans, counters, asked):
    tables = library(spark, books, genres, loans, list(counters.items()) or None)
    requests = spark.createDataFrame([(r, at(s), *rest) for r, s, *rest in asked], CATALOGUE_REQUEST)
    change = batch.apply_catalogue(tables, requests)
    shelf, names, kept, next_id, out = serially(books, genres, loans, counters, asked)
    got = change.outcomes.collect()
    assert len(got) == len(asked)
    assert {r.request_id: (r.outcome, r.restored_quantity) for r in got} == out
    state = change.tables
    assert {b.id: (b.title, b.author, b.genre_id, b.quantity, b.created_at) for b in state.books.collect()} == shelf
    assert {g.id: g.name for g in state.genres.collect()} == names
    assert {b.id for b in state.borrows.collect()} == kept
    given = {c.tbl: c.next_id for c in state.counters.collect()}
    assert {t: given[t] for t in next_id} == next_id
    return {r.request_id: (r.outcome, r.message) for r in got}


def random_requests(seed, n):
    draw = random.Random(seed)
    kinds = ["add_book", "edit_book", "edit_book", "delete_book", "add_genre", "add_genre", "delete_genre", "delete_genre", "rename", None]
    return [
        (
            1000 + i, draw.randrange(n // 2), draw.choice([1, 1, 1, 1, 2, 9]), draw.choice(kinds[:-1]), str(draw.randrange(14)),
            draw.choice(["A", " B ", "c" * 256]) if draw.random() < 0.2 else f"T{i}", "au", str(draw.randrange(12)), str(draw.choice([0, 3, 2**31])), draw.choice(["Fiction", "fiction ", "Art", "art", "New", "x" * 101, None]),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_batch_equals_serial_replay(spark, seed):
    books = [(1, 3, 1), (2, 0, 2), (3, 5, None), (6, 1, 2)]
    genres = [(1, "Fiction"), (2, "Art"), (5, "Poems")]
    loans = [(1, 1, "active"), (2, 1, "overdue"), (3, 2, "returned"), (4, 6, "active")]
    counters = {"books": 9, "genres": 7} if seed % 2 else {}
    check(spark, books, genres, loans, counters, random_requests(seed, 120))


def test_names_are_freed_and_given_again(spark):
    asked = []
    for i in range(6):
        asked += [(10 * i, 10 * i, 1, "add_genre", None, None, None, None, None, "Loop"), (10 * i + 1, 10 * i + 1, 1, "add_genre", None, None, None, None, None, "LOOP ")]
        # Adds take keys in order, accepted or not: 1 and 2, 3 and 4, ...
        asked += [(10 * i + 2, 10 * i + 2, 1, "edit_book", "1", "t", "a", str(2 * i + 1), "4", None), (10 * i + 3, 10 * i + 3, 1, "delete_genre", None, None, None, str(2 * i + 1), None, None)]
    got = check(spark, [(1, 1, None)], [], [], {}, asked)
    assert [got[10 * i + k][0] for i in range(6) for k in range(4)] == ["added", "exists", "updated", "deleted"] * 6
    assert got[0][1] == 'Genre "Loop" added.' and got[2][1] == "Book updated."


def test_deleted_genres_refuse_later_and_unlink_earlier_edits(spark):
    fields = lambda g: ("1", "t", "a", g, "4", None)
    asked = [
        (1, 30, 1, "edit_book", *fields("1")),
        (2, 20, 1, "delete_genre", None, None, None, "1", None, None),
        (3, 10, 1, "edit_book", *fields("1")),
        (4, 40, 1, "delete_book", "1", None, None, None, None, None),
        (5, 50, 1, "delete_book", "1", None, None, None, None, None),
        (6, 60, 1, "edit_book", *fields(None)),
        (7, 25, 1, "add_book", None, "n", "a", "1", "4", None),
    ]
    got = check(spark, [(1, 2, 1), (2, 2, 1)], [(1, "Art")], [(1, 1, "active")], {}, asked)
    assert {r: o for r, (o, _) in got.items()} == {1: "unknown_genre", 2: "deleted", 3: "updated", 4: "deleted", 5: "no_such_book", 6: "no_such_book", 7: "unknown_genre"}


def test_empty_batch(spark):
    check(spark, [(1, 2, 1)], [(1, "Art")], [(1, 1, "active")], {}, [])
    check(spark, [], [], [], {}, [(1, 1, 1, "add_book", None, "n", "a", None, "4", None), (2, 2, 1, "delete_book", "1", None, None, None, None, None)])


# --- counters -------------------------------------------------------------------


def next_ids(tables):
    return {r.tbl: r.next_id for r in tables.counters.collect()}


def add_book(spark, request_id=1):
    return spark.createDataFrame([(request_id, NOON, 1, "add", None, "n", "a", None, "1")], BOOK_REQUEST)


def test_keys_of_deleted_rows_are_not_given_again(spark):
    tables = starter_tables(spark)
    gone = spark.createDataFrame([(1, NOON, 1, "delete", "6", None, None, None, None)], BOOK_REQUEST)
    left = catalogue.delete_books(tables, gone).tables
    after = catalogue.add_books(left, add_book(spark)).tables
    assert sorted(b.id for b in after.books.collect()) == [1, 2, 3, 4, 5, 7] and next_ids(after)["books"] == 8
    # Also without counters from the start: the deletion leaves one.
    plain = catalogue.delete_books(tables.replace(counters=None), gone).tables
    assert max(b.id for b in catalogue.add_books(plain, add_book(spark)).tables.books.collect()) == 7


def test_counters_outlive_a_snapshot(spark):
    folder = f"{work_folder(spark)}/snapshot"
    gone = spark.createDataFrame([(1, NOON, 1, "delete", "8", None)], GENRE_REQUEST)
    files.write_tables(catalogue.delete_genres(starter_tables(spark), gone).tables, folder)
    again = files.read_tables(spark, folder)
    assert next_ids(again) == {"books": 7, "borrows": 8, "genres": 9, "users": 11}
    asked = spark.createDataFrame([(1, NOON, 1, "add", None, "Travel")], GENRE_REQUEST)
    assert max(g.id for g in catalogue.add_genres(again, asked).tables.genres.collect()) == 9


def test_starter_users_go_on_at_eleven(spark):
    asked = spark.createDataFrame([(2**62, at(1), "zoe", "p"), (-(2**62), at(2), "yan", "p"), (5, at(3), "ZOE", "p")], REGISTER_REQUEST)
    after = accounts.register_users(starter_tables(spark), asked).tables
    assert {u.username: u.id for u in after.users.collect() if u.id > 9} == {"zoe": 11, "yan": 12}
    assert next_ids(after)["users"] == 13


def test_keys_beyond_doubles(spark):
    big = 2**60 + 1
    tables = library(spark, [(1, 1, None)], [], counters=[("books", big)])
    for request_id in (2**63 - 1, -(2**63)):
        after = catalogue.add_books(tables, add_book(spark, request_id)).tables
        assert max(b.id for b in after.books.collect()) == big and next_ids(after)["books"] == big + 1


def test_loans_go_on_from_the_counter(spark):
    tables = library(spark, [(1, 5, None)], [], counters=[("borrows", 40)])
    asked = spark.createDataFrame([(100 + i, at(i), 2, kind, 1, None) for i, kind in enumerate(["borrow", "return", "borrow"])], LEDGER_REQUEST)
    after = ledger.replay(tables, asked).tables
    assert sorted(b.id for b in after.borrows.collect()) == [40, 42] and next_ids(after)["borrows"] == 43


def test_numbers_have_no_gap_across_partitions(spark):
    rows = spark.range(2000).selectExpr("id * 7919 % 2003 AS k", "id % 3 = 0 AS third")
    got = {r.k: (r.n, r.m) for r in numbered(rows, ["k"], n=rows["third"], m=rows["k"] >= 0).collect()}
    want, thirds = {}, 0
    for place, r in enumerate(sorted(rows.collect()), 1):
        thirds += r.third
        want[r.k] = (thirds if r.third else None, place)
    assert got == want


def test_login_takes_the_first_user_of_a_name(spark):
    users = spark.createDataFrame([(7, "ann ", "900150983cd24fb0d6963f7d28e17f72", "user", NOON), (3, "Ann", "x", "user", NOON)], USERS)
    asked = spark.createDataFrame([(1, NOON, "ANN", "abc")], REGISTER_REQUEST)
    assert [r.outcome for r in accounts.login_audit(users, asked).collect()] == ["denied"]

"""Batch changes, role gate, keys and constraint checks on hand-written cases."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import accounts, catalogue, checks
from shelfspark.operators.migration import normalise_genres
from shelfspark.operators.requests import dense_keys, role_gate
from shelfspark.plans import reports as r
from shelfspark.schema import BOOK_REQUEST, BOOKS, GENRE_REQUEST, LEGACY_BOOKS, REGISTER_REQUEST, USERS
from shelfspark.sources import files
from shelfspark.sources.seed import starter_password, starter_tables

NOON = dt.datetime(2026, 5, 1, 12)
ADMIN, MEMBER = 1, 5


def at(minutes):
    return NOON + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def tables(spark):
    return starter_tables(spark)


def outcomes(change):
    return {row.request_id: row.outcome for row in change.outcomes.collect()}


def messages(change):
    return {row.request_id: row.message for row in change.outcomes.collect()}


def register(spark, *rows):
    return spark.createDataFrame([(i, at(m), name, pw) for i, m, name, pw in rows], REGISTER_REQUEST)


def books(spark, kind, *rows):
    """rows: request_id, minute, user, book_id, title, author, genre_id, quantity"""
    return spark.createDataFrame(
        [(i, at(m), user, kind, *rest) for i, m, user, *rest in rows], BOOK_REQUEST
    )


def genres(spark, kind, *rows):
    return spark.createDataFrame([(i, at(m), user, kind, g, n) for i, m, user, g, n in rows], GENRE_REQUEST)


def test_register(spark, tables):
    asked = register(
        spark,
        (10, 5, " Nova\t", "secret"),
        (11, 1, "nova", "other"),  # earlier, so this one wins
        (12, 2, "ADMIN ", "x"),  # taken, but for case and blanks
        (13, 3, "n" * 51, "x"),
        (14, 3, "Zoë", " pw "),
        (15, 4, "ZOE", "x"),
    )
    change = accounts.register_users(tables, asked)
    assert outcomes(change) == {
        10: "taken", 11: "registered", 12: "taken", 13: "too_long", 14: "registered", 15: "taken"
    }
    assert messages(change)[11] == "Account created! You can now log in."
    assert messages(change)[12] == "Username already taken."
    added = {row.username: row for row in change.tables.users.where("id > 9").collect()}
    assert set(added) == {"nova", "Zoë"}
    assert added["Zoë"].password == hashlib.md5(b" pw ").hexdigest()
    assert (added["nova"].role, added["nova"].created_at) == ("user", at(1))
    assert added["nova"].id < added["Zoë"].id
    assert checks.duplicate_keys(change.tables.users).isEmpty()
    assert checks.duplicate_names(change.tables.users, "username").isEmpty()


def test_login(spark, tables):
    tries = register(
        spark,
        (1, 0, "ADMIN ", starter_password("admin")),
        (2, 0, "admin", starter_password("dex")),
        (3, 0, "nobody", "x"),
        (4, 0, "dex", starter_password("dex").upper()),
    )
    found = {row.request_id: (row.outcome, row.message) for row in accounts.login_audit(tables.users, tries).collect()}
    denied = ("denied", "Invalid username or password.")
    assert found == {1: ("accepted", ""), 2: denied, 3: denied, 4: denied}


def test_role_gate(spark, tables):
    users = tables.users.unionByName(
        spark.createDataFrame([(20, "ghost", "x", None, NOON), (21, "clerk", "x", "clerk", NOON)], USERS)
    )
    asked = spark.createDataFrame([(i, u) for i, u in enumerate([1, 5, 20, 21, 99])], "request_id long, user_id long")

    def permitted(role):
        gate = role_gate(asked, users, role)
        return {row.request_id for row in gate.collect() if row.outcome == "permitted"}

    assert permitted("admin") == {0}
    assert permitted("user") == {1}


def test_add_books(spark, tables):
    asked = books(
        spark,
        "add",
        (1, 0, ADMIN, None, "\t Dune \n", " Herbert ", "3", "12abc"),
        (2, 1, ADMIN, None, "Emma", "Austen", "", "-5"),
        (3, 2, ADMIN, None, "Ulysses", "Joyce", "77", "1"),
        (4, 3, MEMBER, None, "Mine", "Me", "1", "1"),
        (5, 4, ADMIN, None, "x" * 256, "Me", "1", "1"),
        (6, 5, ADMIN, None, "Big", "Me", "1", "9999999999"),
    )
    change = catalogue.add_books(tables, asked)
    assert outcomes(change) == {
        1: "added", 2: "added", 3: "unknown_genre", 4: "forbidden", 5: "too_long", 6: "out_of_range"
    }
    assert messages(change)[1] == 'Book "Dune" added.'
    assert messages(change)[4] == ""
    added = [tuple(row) for row in change.tables.books.where("id > 6").orderBy("id").collect()]
    assert added == [(7, "Dune", "Herbert", 12, 3, at(0)), (8, "Emma", "Austen", 0, None, at(1))]


def test_edit_books(spark, tables):
    asked = books(
        spark,
        "edit",
        (1, 9, ADMIN, "1", "Last", "B", "0", "4"),
        (2, 1, ADMIN, "1", "First", "A", "2", "9"),
        (3, 10, ADMIN, "1", "Refused", "C", "99", "1"),  # later, but not valid
        (4, 2, ADMIN, "404", "Gone", "D", "1", "1"),
        (5, 2, MEMBER, "2", "No", "E", "1", "1"),
    )
    change = catalogue.edit_books(tables, asked)
    assert outcomes(change) == {
        1: "updated", 2: "updated", 3: "unknown_genre", 4: "no_such_book", 5: "forbidden"
    }
    assert messages(change)[4] == "Book updated."
    after = {row.id: row for row in change.tables.books.collect()}
    assert tuple(after[1])[1:5] == ("Last", "B", 4, None)
    assert after[2].title == "JavaScript" and len(after) == 6
    assert change.tables.books.columns == BOOKS.fieldNames()


def test_add_genres(spark, tables):
    asked = genres(
        spark,
        "add",
        (1, 3, ADMIN, None, "Poetry"),
        (2, 1, ADMIN, None, " POETRY "),
        (3, 1, ADMIN, None, "fiction"),
        (4, 2, ADMIN, None, "Art"),
        (5, 0, MEMBER, None, "Cooking"),
        (6, 0, ADMIN, None, "g" * 101),
    )
    change = catalogue.add_genres(tables, asked)
    assert outcomes(change) == {
        1: "exists", 2: "added", 3: "exists", 4: "added", 5: "forbidden", 6: "too_long"
    }
    assert messages(change)[2] == 'Genre "POETRY" added.'
    assert [tuple(x) for x in change.tables.genres.where("id > 8").orderBy("id").collect()] == [
        (9, "POETRY"), (10, "Art")
    ]


def test_delete_genres(spark, tables):
    asked = genres(spark, "delete", (1, 0, ADMIN, "5", None), (2, 1, ADMIN, "5", None), (3, 0, MEMBER, "6", None))
    change = catalogue.delete_genres(tables, asked)
    assert outcomes(change) == {1: "deleted", 2: "no_such_genre", 3: "forbidden"}
    assert {row.id: row.genre_id for row in change.tables.books.collect()} == {
        1: None, 2: None, 3: None, 4: None, 5: 6, 6: 1
    }
    assert change.tables.genres.count() == 7
    assert checks.foreign_key_violations(change.tables).isEmpty()


def test_delete_books_takes_loans_along(spark, tables):
    blank = (None,) * 4
    asked = books(
        spark, "delete", (1, 0, ADMIN, "1", *blank), (2, 1, ADMIN, "1", *blank), (3, 0, ADMIN, "404", *blank)
    )
    change = catalogue.delete_books(tables, asked)
    found = {row.request_id: (row.outcome, row.restored_quantity) for row in change.outcomes.collect()}
    assert found == {1: ("deleted", 5), 2: ("no_such_book", None), 3: ("no_such_book", None)}
    assert sorted(row.id for row in change.tables.borrows.collect()) == [2, 3, 4, 5, 6]
    assert change.tables.books.count() == 5
    assert checks.foreign_key_violations(change.tables).isEmpty()


def test_restricted_deletes(spark, tables):
    asked = tables.users.where("id IN (5, 6)")
    assert [row.id for row in checks.restricted_deletes(asked, tables.borrows, "user_id").collect()] == [5]


def test_normalise_joins_spellings(spark):
    rows = [
        (1, "a", "x", 1, " Sci-Fi ", NOON),
        (2, "b", "x", 1, "sci-fi", NOON),
        (3, "c", "x", 1, "", NOON),
        (4, "d", "x", 1, None, NOON),
        (5, "e", "x", 1, "art", NOON),
    ]
    new_books, new_genres = normalise_genres(spark.createDataFrame(rows, LEGACY_BOOKS))
    assert sorted(tuple(x) for x in new_genres.collect()) == [(1, "art"), (2, "Sci-Fi")]
    assert {x.id: x.genre_id for x in new_books.collect()} == {1: 2, 2: 2, 3: None, 4: None, 5: 1}


def test_dense_keys_have_no_gap_across_partitions(spark):
    df = spark.range(0, 5000, 1, 16).withColumn("k", F.xxhash64("id")).repartition(16)
    keyed = dense_keys(df.select("k"), [F.col("k")], F.lit(100)).orderBy("k").collect()
    assert [row.id for row in keyed] == list(range(101, 5101))


def test_starter_tables_break_no_rule(tables):
    for name, rows in checks.all_violations(tables).items():
        assert rows.isEmpty(), name


def test_checks_find_broken_rows(spark, tables):
    twice = tables.books.unionByName(tables.books.where("id = 2"))
    assert [tuple(x) for x in checks.duplicate_keys(twice).collect()] == [(2, 2)]
    named = spark.createDataFrame([(1, "Art"), (2, "art "), (3, "Árt"), (4, "Poetry")], "id int, name string")
    assert [tuple(x) for x in checks.duplicate_names(named, "name").collect()] == [("Art", 3)]
    holes = tables.books.withColumn("title", F.when(F.col("id") != 3, F.col("title")))
    assert [x.id for x in checks.missing_values(holes, BOOKS).collect()] == [3]
    lost = tables.borrows.withColumn("status", F.when(F.col("id") == 4, "lost").otherwise(F.col("status")))
    assert [x.id for x in checks.bad_status(lost).collect()] == [4]
    again = tables.borrows.unionByName(tables.borrows.where("id = 2").withColumn("id", F.lit(50).cast("long")))
    assert [tuple(x) for x in checks.repeated_open_loans(again).collect()] == [(5, 6, 2)]
    long = tables.users.withColumn("username", F.repeat("username", 20))
    assert {x.id for x in checks.too_long(long, "users").collect()} == {1, 2, 5, 6, 8, 9} - {
        x.id for x in long.where(F.length("username") <= 50).collect()
    }
    orphans = checks.foreign_key_violations(tables.replace(users=tables.users.where("id <> 9")))
    assert sorted(tuple(x) for x in orphans.collect()) == [("borrows", "user_id", 5), ("borrows", "user_id", 6)]


def test_form_rules(spark):
    accounts_asked = register(spark, (1, 0, " ", "abcd"), (2, 0, "x", "abc"), (3, 0, "x", "abcd"))
    found = {x.request_id: x.message for x in checks.invalid_requests(accounts_asked, "register").collect()}
    assert found == {1: "username is required", 2: "password is too short"}
    login = {x.request_id for x in checks.invalid_requests(accounts_asked, "login").collect()}
    assert login == {1}
    forms = books(
        spark,
        "add",
        (1, 0, 1, None, "T", "A", "", "0"),
        (2, 0, 1, None, "T", "A", "", "-1"),
        (3, 0, 1, None, "", "A", "", "1"),
        (4, 0, 1, None, "T", None, "", "1"),
        (5, 0, 1, None, "T", "A", "", ""),
        (6, 0, 1, None, "T", "A", "", "2"),
    )
    assert {x.request_id for x in checks.invalid_requests(forms, "add_book").collect()} == {1, 2, 3, 4, 5}
    assert {x.request_id for x in checks.invalid_requests(forms, "edit_book").collect()} == {2, 3, 4, 5}
    named = genres(spark, "add", (1, 0, 1, None, " \t"), (2, 0, 1, None, "x"))
    assert {x.request_id for x in checks.invalid_requests(named, "add_genre").collect()} == {1}
    with pytest.raises(ValueError):
        checks.invalid_requests(named, "rename")


@pytest.mark.parametrize("by_member", [False, True])
def test_written_tables_read_back(spark, tables, tmp_path, by_member):
    folder = str(tmp_path / "v1")
    files.write_tables(tables, folder, by_member)
    back = files.read_tables(spark, folder)
    for name in ("books", "borrows", "genres", "users"):
        assert sorted(map(str, getattr(back, name).collect())) == sorted(map(str, getattr(tables, name).collect()))
    with pytest.raises(Exception, match="exists"):
        files.write_tables(tables, folder)
    plan = r.active_borrows(back.at(dt.date(2026, 4, 14)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [status" in plan


def test_requests_read_back(spark, tmp_path):
    folder = str(tmp_path / "asked")
    asked = register(spark, (1, 0, "a", "b"))
    asked.write.parquet(folder)
    assert files.read_requests(spark, folder, "register").collect() == asked.collect()


@pytest.mark.parametrize("kind", ["delete", "archive", ""])
def test_requests_of_another_kind_change_nothing(spark, tables, kind):
    asked = books(spark, kind, (1, 0, ADMIN, "1", "T", "A", "1", "2"), (2, 1, MEMBER, "1", "T", "A", "1", "2"))
    for apply in (catalogue.add_books, catalogue.edit_books):
        change = apply(tables, asked)
        assert outcomes(change) == {1: "unknown_kind", 2: "forbidden"}
        assert sorted(change.tables.books.collect()) == sorted(tables.books.collect())
    named = genres(spark, kind, (1, 0, ADMIN, "1", "New shelf"))
    assert outcomes(catalogue.add_genres(tables, named)) == {1: "unknown_kind"}


def test_deletions_refuse_other_kinds(spark, tables):
    asked = books(spark, "edit", (1, 0, ADMIN, "1", None, None, None, None))
    change = catalogue.delete_books(tables, asked)
    assert outcomes(change) == {1: "unknown_kind"} and change.tables.books.count() == tables.books.count()
    change = catalogue.delete_genres(tables, genres(spark, "add", (1, 0, ADMIN, "1", None)))
    assert outcomes(change) == {1: "unknown_kind"} and change.tables.genres.count() == tables.genres.count()

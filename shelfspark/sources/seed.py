"""The small starter library, in the current and in the earlier schema."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession

from shelfspark.schema import BOOKS, BORROWS, GENRES, LEGACY_BOOKS, USERS
from shelfspark.tables import Tables

# The starter rows.
BOOK_ROWS = [
    (1, "PHP & MySQL", "Jon Duckett", 3, 5, "2026-04-01 01:04:33"),
    (2, "JavaScript", "Kyle Simpson", 0, 5, "2026-04-01 01:04:33"),
    (3, "Clean Code", "Robert Martin", 0, 5, "2026-04-01 01:04:33"),
    (4, "Mocking Bird", "Eminem", 7, None, "2026-04-01 01:32:31"),
    (5, "Harry Potter", "Ako", 0, 6, "2026-04-01 01:33:02"),
    (6, "The Hunger Games", "Suzume Collins", 19, 1, "2026-04-13 03:19:33"),
]
LEGACY_GENRES = {6: "Fiction"}
BORROW_ROWS = [
    (1, 8, 1, "2026-04-13 11:17:56"),
    (2, 5, 6, "2026-04-13 11:19:53"),
    (3, 5, 2, "2026-04-13 11:20:03"),
    (4, 5, 4, "2026-04-13 11:20:11"),
    (5, 9, 5, "2026-04-13 11:32:42"),
    (6, 9, 2, "2026-04-13 11:32:51"),
    (7, 2, 1, "2026-04-13 12:02:46"),
]
BORROWS_DUE = dt.date(2026, 4, 20)
GENRE_ROWS = [
    (1, "Fiction"),
    (2, "Non-Fiction"),
    (3, "Science"),
    (4, "Technology"),
    (5, "Programming"),
    (6, "Fantasy"),
    (7, "Mystery"),
    (8, "Biography"),
]
USER_ROWS = [
    (1, "admin", "admin", "2026-04-01 01:04:33"),
    (2, "user", "user", "2026-04-01 01:04:33"),
    (5, "dex", "user", "2026-04-01 01:29:55"),
    (6, "dave", "user", "2026-04-01 01:36:30"),
    (8, "cris", "user", "2026-04-13 03:16:21"),
    (9, "ralp", "user", "2026-04-13 03:31:28"),
]


def _time(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def starter_password(username: str) -> str:
    return f"{username}-opens-the-shelf"


# The keys that the starter tables' counters give next.
NEXT_IDS = [("books", 7), ("borrows", 8), ("genres", 9), ("users", 11)]


def _users(spark: SparkSession) -> DataFrame:
    rows = [
        (key, name, hashlib.md5(starter_password(name).encode()).hexdigest(), role, _time(at))
        for key, name, role, at in USER_ROWS
    ]
    return spark.createDataFrame(rows, USERS)


def _borrows(spark: SparkSession) -> DataFrame:
    rows = [
        (key, user, book, _time(at), BORROWS_DUE, None, "active")
        for key, user, book, at in BORROW_ROWS
    ]
    return spark.createDataFrame(rows, BORROWS)


def starter_tables(spark: SparkSession) -> Tables:
    books = [(*row[:5], _time(row[5])) for row in BOOK_ROWS]
    return Tables(
        books=spark.createDataFrame(books, BOOKS),
        borrows=_borrows(spark),
        genres=spark.createDataFrame(GENRE_ROWS, GENRES),
        users=_users(spark),
        counters=spark.createDataFrame(NEXT_IDS, "tbl string, next_id long"),
    )


def starter_legacy(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books with free-text genre, borrows, users)."""
    books = [(*row[:4], LEGACY_GENRES.get(row[0]), _time(row[5])) for row in BOOK_ROWS]
    return spark.createDataFrame(books, LEGACY_BOOKS), _borrows(spark), _users(spark)

"""Table and request schemas, and the fixed values of the lending rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the lending rules.
STATUSES = ("active", "returned", "overdue")
OPEN_STATUSES = ("active", "overdue")
ADMIN, USER = "admin", "user"
LOAN_DAYS = 7
DUE_SOON_DAYS = 3
SOON_BAND_DAYS = 2
HISTORY_ROWS = 100
TOP_ROWS = 5
MIN_PASSWORD_CHARS = 4
MAX_INT = 2147483647
# Longest text each column accepts.
TEXT_LIMITS = {
    "books": {"title": 255, "author": 255},
    "genres": {"name": 100},
    "users": {"username": 50, "password": 255, "role": 20},
}


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_TIME, _DATE = T.TimestampNTZType(), T.DateType()

BOOKS = _struct(
    ("id", _LONG, False),
    ("title", _TEXT, False),
    ("author", _TEXT, False),
    ("quantity", _INT, False),
    ("genre_id", _INT, True),
    ("created_at", _TIME, False),
)
BORROWS = _struct(
    ("id", _LONG, False),
    ("user_id", _LONG, False),
    ("book_id", _LONG, False),
    ("borrowed_at", _TIME, False),
    ("due_date", _DATE, False),
    ("returned_at", _TIME, True),
    ("status", _TEXT, False),
)
GENRES = _struct(("id", _INT, False), ("name", _TEXT, False))
USERS = _struct(
    ("id", _LONG, False),
    ("username", _TEXT, False),
    ("password", _TEXT, False),
    ("role", _TEXT, True),
    ("created_at", _TIME, False),
)
TABLES = {"books": BOOKS, "borrows": BORROWS, "genres": GENRES, "users": USERS}

# Books as the earlier schema stored them: genre is free text.
LEGACY_BOOKS = _struct(
    ("id", _LONG, False),
    ("title", _TEXT, False),
    ("author", _TEXT, False),
    ("quantity", _INT, False),
    ("genre", _TEXT, True),
    ("created_at", _TIME, False),
)

# Numbers in form requests arrive as text; ``clean_int`` reads them.
LEDGER_REQUEST = _struct(
    ("request_id", _LONG, False),
    ("ts", _TIME, False),
    ("user_id", _LONG, False),
    ("kind", _TEXT, False),
    ("book_id", _LONG, True),
    ("borrow_id", _LONG, True),
)
BOOK_REQUEST = _struct(
    ("request_id", _LONG, False),
    ("ts", _TIME, False),
    ("user_id", _LONG, False),
    ("kind", _TEXT, False),
    ("book_id", _TEXT, True),
    ("title", _TEXT, True),
    ("author", _TEXT, True),
    ("genre_id", _TEXT, True),
    ("quantity", _TEXT, True),
)
GENRE_REQUEST = _struct(
    ("request_id", _LONG, False),
    ("ts", _TIME, False),
    ("user_id", _LONG, False),
    ("kind", _TEXT, False),
    ("genre_id", _TEXT, True),
    ("name", _TEXT, True),
)
# Books and genres in one ordered batch; each kind reads the fields it needs.
CATALOGUE_KINDS = ("add_book", "edit_book", "delete_book", "add_genre", "delete_genre")
CATALOGUE_REQUEST = _struct(
    ("request_id", _LONG, False),
    ("ts", _TIME, False),
    ("user_id", _LONG, False),
    ("kind", _TEXT, False),
    ("book_id", _TEXT, True),
    ("title", _TEXT, True),
    ("author", _TEXT, True),
    ("genre_id", _TEXT, True),
    ("quantity", _TEXT, True),
    ("name", _TEXT, True),
)
REGISTER_REQUEST = _struct(
    ("request_id", _LONG, False),
    ("ts", _TIME, False),
    ("username", _TEXT, False),
    ("password", _TEXT, False),
)
LOGIN_ATTEMPT = REGISTER_REQUEST
REQUESTS = {
    "ledger": LEDGER_REQUEST,
    "book": BOOK_REQUEST,
    "genre": GENRE_REQUEST,
    "catalogue": CATALOGUE_REQUEST,
    "register": REGISTER_REQUEST,
    "login": LOGIN_ATTEMPT,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, in order and cast."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

"""Requests as a browser sends them: query strings and form bodies, read into typed requests.

All of it is Columns.  Of a repeated parameter the last counts; a name without ``=`` has an empty value; ``+`` and
``%XX`` are decoded as UTF-8, and a piece that cannot be decoded stays as it was sent; dots and blanks in names
become underscores.  A missing parameter is null, which the cleaning of the operators reads as empty or 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import clean_int
from shelfspark.schema import CATALOGUE_KINDS, CATALOGUE_REQUEST, LEDGER_REQUEST, conform

# The parameter that asks for each kind of request, by where it is sent.
IN_BODY = {"add_book": "add_book", "edit_book": "edit_book", "add_genre": "add_genre"}
IN_QUERY = {"delete_genre": "delete_genre", "delete_book": "delete_book"}
BORROW, RETURN = "borrow", "return_book"


def _decoded(piece: Column) -> Column:
    return F.coalesce(F.try_url_decode(piece), piece)


def fields(text: Column) -> Column:
    """The (name, value) pairs of a query string or form body, in order; none of a null one."""

    def pair(piece: Column) -> Column:
        name = F.substring_index(piece, "=", 1)
        value = F.substr(piece, F.length(name) + 2)
        return F.struct(F.translate(_decoded(name), ". ", "__").alias("name"), _decoded(value).alias("value"))

    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), "&"), lambda piece: piece != "")
    return F.transform(pieces, pair)


def field(pairs: Column, name: str) -> Column:
    """The last value of a parameter; null where it is missing."""
    return F.try_element_at(F.filter(pairs, lambda pair: pair["name"] == name), F.lit(-1))["value"]


def _read(raw: DataFrame) -> DataFrame:
    return raw.select("request_id", "ts", "user_id", fields(F.col("query")).alias("q"), fields(F.col("body")).alias("b"))


def catalogue_requests(raw: DataFrame) -> DataFrame:
    """``CATALOGUE_REQUEST`` rows from ``raw`` (request_id, ts, user_id, query, body).

    One sending may ask for several things; they count as handled in the order of ``CATALOGUE_KINDS`` by their place: the
    new request id is ``request_id * 5`` plus that place, so ids stay below 2**60.  A sending that asks for none gives no row.
    """
    q, b = F.col("q"), F.col("b")
    value = {name: field(b, name) for name in ("book_id", "title", "author", "genre_id", "quantity", "genre_name")}
    nothing = F.lit(None).cast("string")
    asked = []
    for place, kind in enumerate(CATALOGUE_KINDS):
        sent = field(b, IN_BODY[kind]) if kind in IN_BODY else field(q, IN_QUERY[kind])
        on_book, on_genre = kind.endswith("book"), kind.endswith("genre")
        filled = kind in ("add_book", "edit_book")
        row = F.struct(
            F.lit(place).alias("place"),
            F.lit(kind).alias("kind"),
            (value["book_id"] if kind == "edit_book" else sent if on_book and not filled else nothing).alias("book_id"),
            *((value[name] if filled else nothing).alias(name) for name in ("title", "author")),
            (value["genre_id"] if filled else sent if kind == "delete_genre" else nothing).alias("genre_id"),
            (value["quantity"] if filled else nothing).alias("quantity"),
            (value["genre_name"] if on_genre and kind in IN_BODY else nothing).alias("name"),
        )
        asked.append(F.when(sent.isNotNull(), row))
    rows = _read(raw).select("request_id", "ts", "user_id", F.explode(F.filter(F.array(*asked), lambda row: row.isNotNull())).alias("asked"))
    rows = rows.select((F.col("request_id") * len(CATALOGUE_KINDS) + F.col("asked.place")).alias("request_id"), "ts", "user_id", "asked.*")
    return conform(rows, CATALOGUE_REQUEST)


def ledger_requests(raw: DataFrame) -> DataFrame:
    """``LEDGER_REQUEST`` rows from ``raw``: a borrow and a return may come in one sending, the borrow first.

    Request ids are ``request_id * 2``, and one more for returns.
    """
    book, loan = field(F.col("q"), BORROW), field(F.col("q"), RETURN)
    nothing = F.lit(None).cast("long")
    asked = F.array(
        F.when(book.isNotNull(), F.struct(F.lit(0).alias("place"), F.lit("borrow").alias("kind"), clean_int(book).alias("book_id"), nothing.alias("borrow_id"))),
        F.when(loan.isNotNull(), F.struct(F.lit(1).alias("place"), F.lit("return").alias("kind"), nothing.alias("book_id"), clean_int(loan).alias("borrow_id"))),
    )
    rows = _read(raw).select("request_id", "ts", "user_id", F.explode(F.filter(asked, lambda row: row.isNotNull())).alias("asked"))
    return conform(rows.select((F.col("request_id") * 2 + F.col("asked.place")).alias("request_id"), "ts", "user_id", "asked.*"), LEDGER_REQUEST)

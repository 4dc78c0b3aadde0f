"""Adding, editing and deleting books and genres in batches.

One call applies one kind of request and answers others ``unknown_kind``.  Within
a batch, requests count as handled one after another in the order (ts, request_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.loans import is_open
from shelfspark.functions.text import ci, clean_int, clean_text, zero_to_null
from shelfspark.operators.requests import (
    Change,
    counters_after,
    first_per_key,
    message,
    next_free,
    numbered,
    outcome_rows,
    with_permission,
)
from shelfspark.schema import ADMIN, BOOKS, GENRES, MAX_INT, TEXT_LIMITS, conform
from shelfspark.tables import Tables


def _is_kind(kind: str) -> Column:
    return F.coalesce(F.col("kind") == kind, F.lit(False)).alias("known_kind")


def _book_values(tables: Tables, requests: DataFrame, kind: str) -> DataFrame:
    """Permission, cleaned values and, where they cannot be stored, the reason."""
    cleaned = with_permission(requests, tables.users, ADMIN).select(
        "request_id",
        "ts",
        "permitted",
        _is_kind(kind),
        clean_int("book_id").alias("book_id"),
        clean_text("title").alias("title"),
        clean_text("author").alias("author"),
        zero_to_null(clean_int("genre_id")).alias("genre_id"),
        clean_int("quantity").alias("quantity"),
    )
    known = tables.genres.select(
        F.col("id").cast("bigint").alias("genre_id"), F.lit(True).alias("genre_known")
    )
    limits = TEXT_LIMITS["books"]
    too_long = (F.length("title") > limits["title"]) | (F.length("author") > limits["author"])
    return cleaned.join(known, "genre_id", "left").withColumn(
        "refusal",
        F.when(~F.col("permitted"), "forbidden")
        .when(~F.col("known_kind"), "unknown_kind")
        .when(too_long, "too_long")
        .when(F.col("quantity") > MAX_INT, "out_of_range")
        .when(F.col("genre_id").isNotNull() & F.col("genre_known").isNull(), "unknown_genre"),
    )


def add_books(tables: Tables, requests: DataFrame) -> Change:
    judged = _book_values(tables, requests, "add").withColumn(
        "outcome", F.coalesce("refusal", F.lit("added"))
    )

    def with_added() -> Tables:
        added = numbered(judged.where(F.col("outcome") == "added"), ["ts", "request_id"], n=F.lit(True))
        rows = added.withColumn("id", next_free(tables, "books") + F.col("n") - 1).withColumnRenamed("ts", "created_at")
        counters = counters_after(tables, books=F.coalesce(added.agg(F.max("n")).scalar(), F.lit(0)))
        return tables.replace(books=tables.books.unionByName(conform(rows, BOOKS)), counters=counters)

    outcomes = outcome_rows(judged, {"added": message("book_added", F.col("title"))})
    return Change(with_added, outcomes)


def edit_books(tables: Tables, requests: DataFrame) -> Change:
    """Title, author, genre and quantity are overwritten; the last edit stays."""
    values = _book_values(tables, requests, "edit")
    fields = ("title", "author", "genre_id", "quantity")
    last = (
        values.where(F.col("refusal").isNull())
        .groupBy("book_id")
        .agg(F.max(F.struct("ts", "request_id", *fields)).alias("edit"))
        .withColumnRenamed("book_id", "id")
    )

    def edited(name: str) -> Column:
        new = F.col(f"edit.{name}").cast(BOOKS[name].dataType)
        return F.when(F.col("edit").isNotNull(), new).otherwise(F.col(name)).alias(name)

    books = tables.books.join(last, "id", "left").select(
        "id", *[edited(f.name) if f.name in fields else f.name for f in BOOKS if f.name != "id"]
    )
    present = tables.books.select(F.col("id").alias("book_id"), F.lit(True).alias("present"))
    judged = values.join(present, "book_id", "left").withColumn(
        "outcome",
        F.coalesce("refusal", F.when(F.col("present"), "updated").otherwise("no_such_book")),
    )
    updated = message("book_updated")
    outcomes = outcome_rows(judged, {"updated": updated, "no_such_book": updated})
    return Change(tables.replace(books=conform(books, BOOKS)), outcomes)


def add_genres(tables: Tables, requests: DataFrame) -> Change:
    """New genres; of several requests for one name the earliest wins."""
    named = (
        with_permission(requests, tables.users, ADMIN)
        .withColumn("known_kind", _is_kind("add"))
        .withColumn("name", clean_text("name"))
        .withColumn("name_key", ci("name"))
    )
    fits = F.length("name") <= TEXT_LIMITS["genres"]["name"]
    known = tables.genres.select(ci("name").alias("name_key"))
    fresh = (
        first_per_key(named.where(F.col("permitted") & F.col("known_kind") & fits), "name_key")
        .join(known, "name_key", "left_anti")
        .select("request_id", F.lit(True).alias("fresh"))
    )
    judged = named.join(fresh, "request_id", "left").withColumn(
        "outcome",
        F.when(~F.col("permitted"), "forbidden")
        .when(~F.col("known_kind"), "unknown_kind")
        .when(F.col("fresh"), "added")
        .when(~fits, "too_long")
        .otherwise("exists"),
    )

    def with_added() -> Tables:
        added = numbered(judged.where("fresh").select("ts", "request_id", "name"), ["ts", "request_id"], n=F.lit(True))
        rows = added.withColumn("id", next_free(tables, "genres") + F.col("n") - 1)
        counters = counters_after(tables, genres=F.coalesce(added.agg(F.max("n")).scalar(), F.lit(0)))
        return tables.replace(genres=tables.genres.unionByName(conform(rows, GENRES)), counters=counters)

    outcomes = outcome_rows(
        judged,
        {"added": message("genre_added", F.col("name")), "exists": message("genre_exists")},
    )
    return Change(with_added, outcomes)


def _deletions(
    requests: DataFrame, tables: Tables, id_column: str, present: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The ids to delete, and each request with the id it deletes, if any."""
    asked = with_permission(requests, tables.users, ADMIN).select(
        "request_id", "ts", "permitted", _is_kind("delete"), clean_int(id_column).alias("id")
    )
    first = first_per_key(asked.where("permitted and known_kind"), "id")
    effective = first.join(present.select("id"), "id", "left_semi")
    marked = asked.join(
        effective.select("request_id", F.lit(True).alias("effective")), "request_id", "left"
    )
    return effective.select("id"), marked


def _deletion_outcome(missing: str) -> Column:
    return (
        F.when(~F.col("permitted"), "forbidden")
        .when(~F.col("known_kind"), "unknown_kind")
        .when(F.col("effective"), "deleted")
        .otherwise(missing)
    )


def delete_genres(tables: Tables, requests: DataFrame) -> Change:
    """Books of a deleted genre stay, with no genre."""
    gone, marked = _deletions(requests, tables, "genre_id", tables.genres)
    unlinked = gone.select(F.col("id").cast("int").alias("genre_id"), F.lit(True).alias("unlink"))
    books = tables.books.join(unlinked, "genre_id", "left").withColumn(
        "genre_id", F.when(F.col("unlink").isNull(), F.col("genre_id"))
    )
    genres = tables.genres.join(gone, "id", "left_anti")
    deleted = message("genre_deleted")
    outcomes = outcome_rows(
        marked.withColumn("outcome", _deletion_outcome("no_such_genre")),
        {"deleted": deleted, "no_such_genre": deleted},
    )
    counters = counters_after(tables, genres=0)
    return Change(tables.replace(books=conform(books, BOOKS), genres=genres, counters=counters), outcomes)


def delete_books(tables: Tables, requests: DataFrame) -> Change:
    """Books go together with all their loans.

    ``restored_quantity`` in the outcomes is the stock with all open copies
    back, as it stands just before the book goes.
    """
    gone, marked = _deletions(requests, tables, "book_id", tables.books)
    gone_loans = gone.withColumnRenamed("id", "book_id")
    # Counted before it meets the deletions, so that a book with a large share
    # of all loans is reduced where its loans are read.
    out = (
        tables.borrows.where(is_open("status"))
        .groupBy(F.col("book_id").alias("id"))
        .agg(F.count("*").alias("out"))
    )
    restored = (
        tables.books.join(gone, "id", "left_semi")
        .join(out, "id", "left")
        .select("id", (F.col("quantity") + F.coalesce("out", F.lit(0))).alias("restored"))
    )
    judged = (
        marked.withColumn("outcome", _deletion_outcome("no_such_book"))
        .join(restored, "id", "left")
        .withColumn("restored_quantity", F.when(F.col("outcome") == "deleted", F.col("restored")))
    )
    deleted = message("book_deleted")
    outcomes = outcome_rows(
        judged, {"deleted": deleted, "no_such_book": deleted}, "restored_quantity"
    )
    return Change(
        tables.replace(
            books=tables.books.join(gone, "id", "left_anti"),
            counters=counters_after(tables, books=0, borrows=0),
            borrows=tables.borrows.join(gone_loans, "book_id", "left_anti").select(
                tables.borrows.columns
            ),
        ),
        outcomes,
    )

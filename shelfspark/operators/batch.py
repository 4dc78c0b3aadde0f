"""Books and genres added, edited and deleted in one ordered batch.

Requests count as handled one after another in the order (ts, request_id), whatever their kind: an edit that names a
genre deleted earlier is refused, one before the deletion loses its genre by it, a request may name a book or a genre that an
earlier one added.  Nothing is replayed row by row:

* Every permitted add takes the next key of its table, accepted or not, as an auto-increment column gives them out.  So all
  keys are known from the order alone.
* A row with a given key lives from its add to the first deletion of that key after it, and never again.  The life spans
  of genres depend on nothing but genre requests: of several adds of one name the first that no living holder of the name
  precedes is accepted, and the next one after that holder's end.  This chain takes a join per link, and as many as
  a name was freed and given again within the batch.
* A book request meets the life span of its genre and that of its book by equal keys and compares positions.  The
  last accepted edit of a book stays, and its genre goes if that genre's life ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.loans import is_open
from shelfspark.functions.text import ci, clean_int, clean_text, zero_to_null
from shelfspark.operators.requests import (
    Change,
    counters_after,
    message,
    next_free,
    numbered,
    outcome_rows,
    with_permission,
)
from shelfspark.schema import ADMIN, BOOKS, CATALOGUE_KINDS, GENRES, MAX_INT, TEXT_LIMITS, conform
from shelfspark.session import work_folder, write_and_reread
from shelfspark.tables import Tables

# Position of what was there before the batch; requests count from 1.
BEFORE = 0
_FIELDS = ("title", "author", "genre_id", "quantity")


def _positioned(tables: Tables, requests: DataFrame, folder: str) -> DataFrame:
    """The requests cleaned, with their place in the batch and the keys that adds take."""
    asked = with_permission(requests, tables.users, ADMIN).select(
        "request_id",
        "ts",
        "permitted",
        F.when(F.col("kind").isin(*CATALOGUE_KINDS), F.col("kind")).otherwise("").alias("kind"),
        clean_int("book_id").alias("book_id"),
        clean_text("title").alias("title"),
        clean_text("author").alias("author"),
        clean_int("genre_id").alias("genre_id"),
        clean_int("quantity").alias("quantity"),
        clean_text("name").alias("name"),
    )
    adds = {kind: F.col("permitted") & (F.col("kind") == f"add_{kind}") for kind in ("book", "genre")}
    placed = numbered(asked, ["ts", "request_id"], at=F.lit(True), **{f"{kind}_no": met for kind, met in adds.items()})
    keys = {f"new_{kind}": next_free(tables, f"{kind}s") + F.col(f"{kind}_no") - 1 for kind in adds}
    return write_and_reread(placed.withColumns(keys), f"{folder}/placed")


def _of_kind(asked: DataFrame, kind: str) -> DataFrame:
    return asked.where(F.col("permitted") & (F.col("kind") == kind))


def _with_end(born: DataFrame, deletions: DataFrame, key: str) -> DataFrame:
    """``born`` (id, birth, …) with the position of the first deletion after the birth, null for those that stay."""
    hits = deletions.select(F.col(key).alias("id"), F.col("at"))
    ends = born.select("id", "birth").join(hits, "id").where(F.col("at") > F.col("birth")).groupBy("id").agg(F.min("at").alias("death"))
    return born.join(ends, "id", "left")


def _alive(at: Column | str = "at") -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.coalesce((F.col("birth") < at) & (F.col("death").isNull() | (F.col("death") > at)), F.lit(False))


def _genre_lives(tables: Tables, asked: DataFrame, folder: str) -> DataFrame:
    """(id, name, birth, death) of every genre that lived at some time of the batch."""
    deletions = _of_kind(asked, "delete_genre")
    before = tables.genres.select(F.col("id").cast("long").alias("id"), "name", F.lit(BEFORE).cast("long").alias("birth"))
    fits = F.length("name") <= TEXT_LIMITS["genres"]["name"]
    adds = _of_kind(asked, "add_genre").where(fits).select(F.col("new_genre").alias("id"), "name", F.col("at").alias("birth"))
    named = write_and_reread(_with_end(before.union(adds), deletions, "genre_id"), f"{folder}/genres")
    lives = named.where(F.col("birth") == BEFORE)
    # Where the name becomes free: after the last of its holders from before; for a name without one at once.
    holders = lives.groupBy(ci("name").alias("k")).agg(F.max(F.coalesce("death", F.lit(2**63 - 1))).alias("free"))
    waiting = named.where(F.col("birth") > BEFORE).withColumn("k", ci("name"))
    frontier = waiting.select("k").distinct().join(holders, "k", "left").select("k", F.coalesce("free", F.lit(BEFORE).cast("long")).alias("free"))
    parts, turn = [lives], 0
    while True:
        turn += 1
        next_add = waiting.join(frontier, "k").where(F.col("birth") > F.col("free")).groupBy("k").agg(F.min(F.struct("birth", "id", "name", "death")).alias("add"))
        taken = write_and_reread(next_add.select("add.*"), f"{folder}/turn-{turn}")
        parts.append(taken)
        frontier = taken.where(F.col("death").isNotNull()).select(ci("name").alias("k"), F.col("death").alias("free"))
        if frontier.isEmpty():
            break
    out = parts[0].select("id", "name", "birth", "death")
    for part in parts[1:]:
        out = out.union(part.select("id", "name", "birth", "death"))
    return write_and_reread(out, f"{folder}/lives")


def _judged_values(asked: DataFrame, lives: DataFrame) -> DataFrame:
    """Adds and edits of books with the reason why they cannot be stored, if any."""
    limits = TEXT_LIMITS["books"]
    values = asked.where(F.col("kind").isin("add_book", "edit_book")).withColumn("genre_id", zero_to_null("genre_id"))
    spans = lives.select(F.col("id").alias("genre_id"), "birth", "death")
    return (
        values.join(spans, "genre_id", "left")
        .withColumn(
            "refusal",
            F.when(~F.col("permitted"), "forbidden")
            .when((F.length("title") > limits["title"]) | (F.length("author") > limits["author"]), "too_long")
            .when(F.col("quantity") > MAX_INT, "out_of_range")
            .when(F.col("genre_id").isNotNull() & ~_alive(), "unknown_genre"),
        )
        .drop("birth", "death")
    )


def apply_catalogue(tables: Tables, requests: DataFrame) -> Change:
    """All of ``requests`` (``CATALOGUE_REQUEST``) in order; ``outcomes`` also have the ``restored_quantity`` of deleted books.

    Kinds that are none of ``CATALOGUE_KINDS`` are answered ``unknown_kind``.  Deleted books go together with their
    loans; ``restored_quantity`` is the stock with all open copies back, as it stands just before the book goes.
    """
    folder = work_folder(requests.sparkSession)
    asked = _positioned(tables, requests, folder)
    genres = _genre_lives(tables, asked, folder)
    values = write_and_reread(_judged_values(asked, genres), f"{folder}/values")

    added = values.where((F.col("kind") == "add_book") & F.col("refusal").isNull())
    rows = tables.books.select("id", *(F.col(f).cast("long" if f in ("genre_id", "quantity") else "string").alias(f) for f in _FIELDS), "created_at", F.lit(BEFORE).cast("long").alias("birth"))
    rows = rows.union(added.select(F.col("new_book").alias("id"), *_FIELDS, F.col("ts").alias("created_at"), F.col("at").alias("birth")))
    books = write_and_reread(_with_end(rows, _of_kind(asked, "delete_book"), "book_id"), f"{folder}/books")
    spans = books.select(F.col("id").alias("book_id"), "birth", "death")

    edits = values.where(F.col("kind") == "edit_book").join(spans, "book_id", "left").withColumn("alive", _alive())
    last = edits.where(F.col("alive") & F.col("refusal").isNull()).groupBy(F.col("book_id").alias("id")).agg(F.max(F.struct("at", *_FIELDS)).alias("edit"))
    written = books.join(last, "id", "left").select(
        "id", "created_at", "birth", "death", *(F.when(F.col("edit").isNotNull(), F.col(f"edit.{f}")).otherwise(F.col(f)).alias(f) for f in _FIELDS)
    )
    ended = genres.where(F.col("death").isNotNull()).select(F.col("id").alias("genre_id"), F.lit(True).alias("ended"))
    kept = written.where(F.col("death").isNull()).join(ended, "genre_id", "left").withColumn("genre_id", F.when(F.col("ended").isNull(), F.col("genre_id")))
    gone = spans.where(F.col("death").isNotNull()).select("book_id")
    state = tables.replace(
        books=conform(kept, BOOKS),
        genres=conform(genres.where(F.col("death").isNull()), GENRES),
        borrows=tables.borrows.join(gone, "book_id", "left_anti").select(tables.borrows.columns),
        counters=counters_after(
            tables, borrows=0, **{f"{kind}s": F.coalesce(asked.agg(F.max(f"{kind}_no")).scalar(), F.lit(0)) for kind in ("book", "genre")}
        ),
    )

    out = tables.borrows.where(is_open("status")).groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("out"))
    restored = (
        written.where(F.col("death").isNotNull())
        .join(out, "id", "left")
        .select(F.col("death").alias("at"), (F.col("quantity") + F.coalesce("out", F.lit(0))).alias("restored_quantity"))
    )
    return Change(state, _outcomes(asked, values, edits, genres, books, restored))


def _outcomes(asked: DataFrame, values: DataFrame, edits: DataFrame, genres: DataFrame, books: DataFrame, restored: DataFrame) -> DataFrame:
    """One row per request, by what it came to."""

    def part(df: DataFrame, outcome: Column) -> DataFrame:
        return df.select("request_id", "at", "title", "name", "kind", outcome.alias("outcome"))

    def deleted(kind: str, lives: DataFrame) -> DataFrame:
        # The request at the position where a life ended is the one that ended it.
        ends = lives.where(F.col("death").isNotNull()).select(F.col("death").alias("at"), F.lit(True).alias("hit"))
        outcome = F.when(~F.col("permitted"), "forbidden").when(F.col("hit"), "deleted").otherwise(f"no_such_{kind}")
        return part(asked.where(F.col("kind") == f"delete_{kind}").join(ends, "at", "left"), outcome)

    born = genres.where(F.col("birth") > BEFORE).select(F.col("birth").alias("at"), F.lit(True).alias("born"))
    genre_added = (
        F.when(~F.col("permitted"), "forbidden")
        .when(F.col("born"), "added")
        .when(F.length("name") > TEXT_LIMITS["genres"]["name"], "too_long")
        .otherwise("exists")
    )
    parts = [
        part(values.where(F.col("kind") == "add_book"), F.coalesce("refusal", F.lit("added"))),
        part(edits, F.coalesce("refusal", F.when(F.col("alive"), "updated").otherwise("no_such_book"))),
        part(asked.where(F.col("kind") == "add_genre").join(born, "at", "left"), genre_added),
        part(asked.where(F.col("kind") == ""), F.when(F.col("permitted"), "unknown_kind").otherwise("forbidden")),
        deleted("genre", genres),
        deleted("book", books),
    ]
    judged = parts[0]
    for more in parts[1:]:
        judged = judged.union(more)
    shown = judged.withColumn("code", F.concat_ws(":", "kind", "outcome")).join(restored, "at", "left")
    texts = {
        "add_book:added": message("book_added", F.col("title")),
        "edit_book:updated": message("book_updated"),
        "edit_book:no_such_book": message("book_updated"),
        "add_genre:added": message("genre_added", F.col("name")),
        "add_genre:exists": message("genre_exists"),
        "delete_genre:deleted": message("genre_deleted"),
        "delete_genre:no_such_genre": message("genre_deleted"),
        "delete_book:deleted": message("book_deleted"),
        "delete_book:no_such_book": message("book_deleted"),
    }
    told = outcome_rows(shown.withColumn("told", F.col("outcome")).withColumn("outcome", F.col("code")), texts, "told", "restored_quantity")
    return told.select("request_id", F.col("told").alias("outcome"), "message", "restored_quantity")

"""Reports kept up to date by changes: per member, per book and per genre.

Counts and latest dates are tables of their own.  A change is a set of signed loans, -1 as they were and +1 as they
are now, and of signed books; it is added up per key and merged into the tables.  Only where the latest date of a member may have
gone with a deleted loan is it looked up again, among that member's loans.  How many loans are overdue depends on the
date of the report, so active loans are counted per due date.
"""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.loans import is_open
from shelfspark.operators.ledger import Replay
from shelfspark.schema import TOP_ROWS, USER
from shelfspark.session import work_folder, write_and_reread
from shelfspark.tables import Tables

_LOAN = ("user_id", "book_id", "borrowed_at", "due_date", "returned_at", "status")
_MEMBER_COUNTS = ("total", "returned", "open", "overdue")


@dataclasses.dataclass(frozen=True)
class Kept:
    """What the reports need: members (id, counts, last_borrow), due (id, due_date, n), books (id, total, out), genres (id, n)."""

    members: DataFrame
    due: DataFrame
    books: DataFrame
    genres: DataFrame

    def written(self) -> Kept:
        """The same as written tables, so that changes do not pile up in the plan."""
        folder = work_folder(self.members.sparkSession)
        return Kept(**{f.name: write_and_reread(getattr(self, f.name), f"{folder}/{f.name}") for f in dataclasses.fields(self)})


def _signed(rows: DataFrame, sign: int, columns: tuple[str, ...]) -> DataFrame:
    return rows.select(F.lit(sign).cast("long").alias("sign"), *columns)


def _count(met: Column | None = None) -> Column:
    """Signed number of rows, of those that meet a condition."""
    return F.coalesce(F.sum(F.col("sign") if met is None else F.when(met, F.col("sign"))), F.lit(0).cast("long"))


def _per_member(signed: DataFrame) -> DataFrame:
    status = F.col("status")
    return signed.groupBy(F.col("user_id").alias("id")).agg(
        _count().alias("total"),
        _count(status == "returned").alias("returned"),
        _count(is_open(status)).alias("open"),
        _count(status == "overdue").alias("overdue"),
        F.max(F.when(F.col("sign") > 0, F.col("borrowed_at"))).alias("last_borrow"),
        F.max(F.when(F.col("sign") < 0, F.col("borrowed_at"))).alias("last_gone"),
    )


def _per_due(signed: DataFrame) -> DataFrame:
    out = signed.where((F.col("status") == "active") & F.col("returned_at").isNull())
    return out.groupBy(F.col("user_id").alias("id"), "due_date").agg(_count().alias("n"))


def _per_book(signed: DataFrame) -> DataFrame:
    return signed.groupBy(F.col("book_id").alias("id")).agg(_count().alias("total"), _count(is_open("status")).alias("out"))


def _per_genre(signed: DataFrame) -> DataFrame:
    return signed.where(F.col("genre_id").isNotNull()).groupBy(F.col("genre_id").alias("id")).agg(_count().alias("n"))


def keep(tables: Tables) -> Kept:
    """The tables of all reports, from one pass over the loans each and one over the books."""
    loans, books = _signed(tables.borrows, 1, _LOAN), _signed(tables.books, 1, ("genre_id",))
    return Kept(_per_member(loans).drop("last_gone"), _per_due(loans), _per_book(loans), _per_genre(books))


def loans_of_replay(before: Tables, replay: Replay) -> DataFrame:
    """The signed loans that a replay opened and closed; of the loans before, those that are still out are read."""
    closed = replay.closed.select("id", "closed_at")
    back = F.col("closed_at").isNotNull()
    ended = {"returned_at": F.coalesce("closed_at", "returned_at"), "status": F.when(back, "returned").otherwise(F.col("status"))}
    loan = [F.col(c) for c in _LOAN]
    was = F.struct(F.lit(-1).cast("long").alias("sign"), *loan)
    now = F.struct(F.lit(1).cast("long").alias("sign"), *(ended.get(c, F.col(c)).alias(c) for c in _LOAN))
    # A loan as it was and as it is come from one join.
    out = before.borrows.where(F.col("returned_at").isNull()).join(closed, "id").select(F.explode(F.array(was, now)).alias("loan"))
    opened = replay.opened.join(closed, "id", "left")
    return out.select("loan.*").unionByName(_signed(opened.withColumns(ended), 1, _LOAN))


def loans_of_deletion(before: Tables, after: Tables) -> DataFrame:
    """The signed loans that went with deleted books."""
    gone = before.books.select(F.col("id").alias("book_id")).join(after.books.select(F.col("id").alias("book_id")), "book_id", "left_anti")
    return _signed(before.borrows.join(gone, "book_id", "left_semi"), -1, _LOAN)


def books_changed(before: Tables, after: Tables) -> DataFrame:
    """The signed books whose genre differs, or that came or went."""
    old = before.books.select("id", F.col("genre_id").alias("old"), F.lit(True).alias("was"))
    new = after.books.select("id", F.col("genre_id").alias("new"), F.lit(True).alias("is"))
    met = old.join(new, "id", "full").where(~F.col("old").eqNullSafe(F.col("new")) | F.col("was").isNull() | F.col("is").isNull())
    parts = (F.when(F.col("was"), F.struct(F.lit(-1).cast("long").alias("sign"), F.col("old").alias("genre_id"))), F.when(F.col("is"), F.struct(F.lit(1).cast("long").alias("sign"), F.col("new").alias("genre_id"))))
    return met.select(F.explode(F.array(*parts)).alias("b")).where("b is not null").select("b.*")


def _merged(kept: DataFrame, change: DataFrame, keys: list[str], counts: tuple[str, ...], live: str) -> DataFrame:
    """Counts of both added up; keys that are left without anything go."""
    both = kept.select(*keys, *counts).unionByName(change.select(*keys, *counts))
    return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts)).where(F.col(live) != 0)


def updated(kept: Kept, after: Tables, loans: DataFrame | None = None, books: DataFrame | None = None) -> Kept:
    """``kept`` with signed loans and books added; ``after`` are the tables with the change."""
    if books is not None:
        kept = dataclasses.replace(kept, genres=_merged(kept.genres, _per_genre(books), ["id"], ("n",), "n"))
    if loans is None:
        return kept
    # Each of the tables reads the change, and the change may be costly to derive.
    folder = work_folder(loans.sparkSession)
    loans = write_and_reread(loans, f"{folder}/loans")
    change = _per_member(loans)
    counts = _merged(kept.members, change, ["id"], _MEMBER_COUNTS, "total")
    latest = kept.members.select("id", F.col("last_borrow").alias("old")).join(change.select("id", "last_borrow", "last_gone"), "id", "full")
    newest = F.greatest("old", "last_borrow")
    # The latest may be gone if a loan of that time went and none as late came.
    gone = F.coalesce((F.col("last_gone") >= F.col("old")) & (F.col("last_borrow").isNull() | (F.col("last_borrow") < F.col("last_gone"))), F.lit(False))
    dated = write_and_reread(counts.join(latest.select("id", newest.alias("newest"), gone.alias("gone")), "id"), f"{folder}/dated")
    members = dated.where(~F.col("gone")).select("id", *_MEMBER_COUNTS, F.col("newest").alias("last_borrow"))
    stale = dated.where("gone").select(F.col("id").alias("user_id"))
    if not stale.isEmpty():
        again = after.borrows.join(stale, "user_id", "left_semi").groupBy(F.col("user_id").alias("id")).agg(F.max("borrowed_at").alias("found"))
        members = members.unionByName(dated.where("gone").join(again, "id", "left").select("id", *_MEMBER_COUNTS, F.col("found").alias("last_borrow")))
    return dataclasses.replace(
        kept,
        members=members,
        due=_merged(kept.due, _per_due(loans), ["id", "due_date"], ("n",), "n"),
        books=_merged(kept.books, _per_book(loans), ["id"], ("total", "out"), "total"),
    )


def user_stats(kept: Kept, tables: Tables, as_of: dt.date) -> DataFrame:
    """The report on members, as ``reports.user_stats`` gives it."""
    late = kept.due.where(F.col("due_date") < F.lit(as_of)).groupBy("id").agg(F.sum("n").alias("late"))
    members = tables.users.where(F.col("role") == USER).select("id", "username", "created_at")
    return (
        members.join(kept.members, "id")
        .join(late, "id", "left")
        .select(
            "id",
            "username",
            "created_at",
            F.col("total").alias("total_borrows"),
            F.col("returned").alias("returned_count"),
            F.col("open").alias("active_count"),
            (F.col("overdue") + F.coalesce("late", F.lit(0))).alias("overdue_count"),
            "last_borrow",
        )
        .orderBy(F.desc("total_borrows"), "id")
    )


def top_books(kept: Kept, tables: Tables) -> DataFrame:
    """The books lent most, as ``reports.top_books`` gives them."""
    known = kept.books.join(tables.books.select("id"), "id", "left_semi")
    top = known.orderBy(F.desc("total"), "id").limit(TOP_ROWS)
    joined = tables.books.join(F.broadcast(top), "id")
    names = tables.genres.select(F.col("id").alias("genre_id"), F.col("name").alias("genre_name"))
    # At most TOP_ROWS rows reach this unpartitioned window.
    place = F.row_number().over(W.orderBy(F.desc("total"), "id"))
    return joined.join(names, "genre_id", "left").select(
        place.alias("rank"), "id", "title", "author", "quantity", "genre_name", F.col("total").alias("borrow_count"), F.col("out").alias("currently_out")
    )


def genre_stats(kept: Kept, tables: Tables) -> DataFrame:
    """The report on genres, as ``reports.genre_stats`` gives it."""
    sizes = tables.genres.join(kept.genres, "id", "left").select("id", "name", F.coalesce("n", F.lit(0).cast("long")).alias("book_count"))
    return sizes.orderBy(F.desc("book_count"), "id").select(F.col("name").alias("genre_name"), "book_count")

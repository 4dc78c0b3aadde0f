"""The fixed reports.

Every report takes a ``Snapshot`` and returns a lazy DataFrame with the same
rows in the same order for the same input: each sort ends in a key.  Adaptive
execution broadcasts a side when its measured size allows it and splits
partitions that one busy member or book makes too large; only rows whose number
a LIMIT bounds are broadcast by hint.

Top-k reports first drop loans without their member or book, by semi joins on keys, then pick their
rows, so the joins that add names see k rows instead of all loans.  Where the declared keys are known to
hold (``foreign_key_violations`` finds nothing), ``trust_keys=True`` spares the semi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions import display as d
from shelfspark.functions.loans import days_since, days_until, due_soon_limit, is_open
from shelfspark.functions.text import ci
from shelfspark.schema import HISTORY_ROWS, TOP_ROWS, USER
from shelfspark.tables import Snapshot


def _members(snap: Snapshot) -> DataFrame:
    return snap.users.select(F.col("id").alias("user_id"), "username")


def _titles(snap: Snapshot, *columns: str) -> DataFrame:
    return snap.books.select(F.col("id").alias("book_id"), *columns)


def _with_genre_name(df: DataFrame, snap: Snapshot) -> DataFrame:
    names = snap.genres.select(F.col("id").alias("genre_id"), F.col("name").alias("genre_name"))
    return df.join(names, "genre_id", "left")


def _with_partners(loans: DataFrame, snap: Snapshot) -> DataFrame:
    return loans.join(_members(snap), "user_id", "left_semi").join(
        _titles(snap), "book_id", "left_semi"
    )


def kpi_summary(snap: Snapshot) -> DataFrame:
    """One row; one pass over the open loans for both loan counts."""
    loans = snap.open_loans.agg(
        F.count("*").alias("open_borrows"),
        F.count_if(F.col("status") == "overdue").alias("overdue"),
    )

    def rows(df: DataFrame) -> Column:
        return df.agg(F.count("*")).scalar()

    return loans.select(
        rows(snap.books).alias("total_books"),
        rows(snap.users.where(F.col("role") == USER)).alias("total_users"),
        "open_borrows",
        "overdue",
        rows(snap.genres).alias("total_genres"),
    )


def active_borrows(snap: Snapshot) -> DataFrame:
    joined = snap.open_loans.join(_members(snap), "user_id").join(
        _titles(snap, "title", "author", "genre_id"), "book_id"
    )
    return (
        _with_genre_name(joined, snap)
        .select(
            "id",
            "borrowed_at",
            "due_date",
            "status",
            "returned_at",
            "username",
            F.col("user_id").alias("uid"),
            "title",
            "author",
            "genre_name",
            days_until("due_date", snap.as_of).alias("days_remaining"),
        )
        .orderBy("due_date", "id")
    )


def active_borrows_display(snap: Snapshot) -> DataFrame:
    return active_borrows(snap).select(
        "*",
        d.genre_cell("genre_name").alias("genre_text"),
        d.days_text("days_remaining").alias("days_text"),
        d.due_band("days_remaining").alias("due_band"),
        F.round(d.time_bar("days_remaining"), 6).alias("time_bar"),
    )


def borrow_history(snap: Snapshot, trust_keys: bool = False) -> DataFrame:
    stored = snap.loans if trust_keys else _with_partners(snap.loans, snap)
    newest_first = (F.desc("borrowed_at"), F.desc("id"))
    latest = stored.orderBy(*newest_first).limit(HISTORY_ROWS)
    named = _members(snap).join(F.broadcast(latest), "user_id")
    joined = _titles(snap, "title", "genre_id").join(F.broadcast(named), "book_id")
    return (
        _with_genre_name(joined, snap)
        .select(
            "id",
            "borrowed_at",
            "due_date",
            "returned_at",
            "status",
            "username",
            "title",
            "genre_name",
        )
        .orderBy(*newest_first)
    )


def user_stats(snap: Snapshot) -> DataFrame:
    """Members with at least one loan.

    Loans are counted per member before the join, so the join meets one row per
    member and no member's loans gather in one task.
    """
    counts = snap.loans.groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").alias("total_borrows"),
        F.count_if(F.col("status") == "returned").alias("returned_count"),
        F.count_if(is_open("status")).alias("active_count"),
        F.count_if(F.col("status") == "overdue").alias("overdue_count"),
        F.max("borrowed_at").alias("last_borrow"),
    )
    members = snap.users.where(F.col("role") == USER).select("id", "username", "created_at")
    return (
        members.join(counts, "id")
        .select("id", "username", "created_at", *counts.columns[1:])
        .orderBy(F.desc("total_borrows"), "id")
    )


def user_stats_display(snap: Snapshot) -> DataFrame:
    return user_stats(snap).select("*", d.minute_text("last_borrow").alias("last_borrow_text"))


def top_books(snap: Snapshot, trust_keys: bool = False) -> DataFrame:
    """Both counts from one aggregate; open loans need no sweep to be told apart."""
    counts = snap.tables.borrows.groupBy("book_id").agg(
        F.count("*").alias("borrow_count"),
        F.count_if(is_open("status")).alias("currently_out"),
    )
    if not trust_keys:
        counts = counts.join(_titles(snap), "book_id", "left_semi")
    top = counts.orderBy(F.desc("borrow_count"), "book_id").limit(TOP_ROWS)
    titles = _titles(snap, "title", "author", "quantity", "genre_id")
    joined = titles.join(F.broadcast(top), "book_id")
    # At most TOP_ROWS rows reach this unpartitioned window.
    place = F.row_number().over(W.orderBy(F.desc("borrow_count"), "book_id"))
    return (
        _with_genre_name(joined, snap)
        .select(
            place.alias("rank"),
            F.col("book_id").alias("id"),
            "title",
            "author",
            "quantity",
            "genre_name",
            "borrow_count",
            "currently_out",
        )
        .orderBy("rank")
    )


def never_borrowed(snap: Snapshot) -> DataFrame:
    """Loans reduce to distinct book keys before the anti join."""
    borrowed = snap.tables.borrows.select(F.col("book_id").alias("id")).distinct()
    idle = snap.books.join(borrowed, "id", "left_anti")
    return _with_genre_name(idle, snap).select("id", "title", "author", "quantity", "genre_name")


def _genre_sizes(snap: Snapshot) -> DataFrame:
    """Every genre with its number of titles, 0 included."""
    sizes = (
        snap.books.where(F.col("genre_id").isNotNull())
        .groupBy(F.col("genre_id").alias("id"))
        .agg(F.count("*").alias("n"))
    )
    return snap.genres.join(sizes, "id", "left").select(
        "id", "name", F.coalesce("n", F.lit(0)).alias("book_count")
    )


def genre_stats(snap: Snapshot) -> DataFrame:
    return (
        _genre_sizes(snap)
        .orderBy(F.desc("book_count"), "id")
        .select(F.col("name").alias("genre_name"), "book_count")
    )


def genre_catalogue(snap: Snapshot) -> DataFrame:
    return _genre_sizes(snap).orderBy(ci("name"), "id")


def genre_list(snap: Snapshot) -> DataFrame:
    return snap.genres.select("id", "name").orderBy(ci("name"), "id")


def overdue_top(snap: Snapshot, trust_keys: bool = False) -> DataFrame:
    late = snap.overdue_loans if trust_keys else _with_partners(snap.overdue_loans, snap)
    # The most days late is the earliest due date.
    latest = late.select("id", "user_id", "book_id", "due_date").orderBy("due_date", "id")
    named = _members(snap).join(F.broadcast(latest.limit(TOP_ROWS)), "user_id")
    joined = _titles(snap, "title").join(F.broadcast(named), "book_id")
    return joined.orderBy("due_date", "id").select(
        "username",
        "title",
        "due_date",
        days_since("due_date", snap.as_of).alias("days_late"),
    )


def _due_soon_loans(snap: Snapshot) -> DataFrame:
    return snap.active_loans.where(F.col("due_date") <= due_soon_limit(snap.as_of))


def due_soon(snap: Snapshot) -> DataFrame:
    soon = _due_soon_loans(snap)
    joined = soon.join(_members(snap), "user_id").join(_titles(snap, "title"), "book_id")
    return joined.select(
        "id",
        "due_date",
        "username",
        "title",
        days_until("due_date", snap.as_of).alias("days_rem"),
    ).orderBy("due_date", "id")


def due_soon_display(snap: Snapshot) -> DataFrame:
    return due_soon(snap).select("*", d.due_soon_text("days_rem").alias("due_text"))


def dashboard_panels(snap: Snapshot) -> DataFrame:
    """Which optional panels have anything to show; each probe stops at one row."""
    return snap.tables.borrows.sparkSession.range(1).select(
        snap.overdue_loans.exists().alias("overdue"),
        _due_soon_loans(snap).exists().alias("due_soon"),
    )


def catalogue(snap: Snapshot) -> DataFrame:
    return (
        _with_genre_name(snap.books, snap)
        .select(*snap.books.columns, "genre_name")
        .orderBy(ci("title"), "id")
    )


def catalogue_display(snap: Snapshot) -> DataFrame:
    return catalogue(snap).select(
        "*",
        d.genre_cell("genre_name").alias("genre_text"),
        d.stock_badge("quantity").alias("stock_badge"),
        d.day_text("created_at").alias("added_text"),
    )


def my_borrows(snap: Snapshot, user_id: int | None = None) -> DataFrame:
    """Open loans of one member, or of all members with ``user_id`` as a column."""
    loans, owner = snap.open_loans, []
    if user_id is None:
        owner = ["user_id"]
    else:
        loans = loans.where(F.col("user_id") == user_id)
    joined = loans.join(_titles(snap, "title", "author", "genre_id"), "book_id")
    return (
        _with_genre_name(joined, snap)
        .select(
            *owner,
            "id",
            "borrowed_at",
            "due_date",
            "status",
            "title",
            "author",
            "genre_name",
            days_until("due_date", snap.as_of).alias("days_rem"),
        )
        .orderBy("due_date", "id")
    )


def my_borrows_display(snap: Snapshot, user_id: int | None = None) -> DataFrame:
    return my_borrows(snap, user_id).select(
        "*", d.member_due_text("status", "days_rem").alias("due_text")
    )


def _held_by(snap: Snapshot, user_id: int) -> DataFrame:
    """(id of book, number of open loans) of one member."""
    mine = snap.tables.borrows.where((F.col("user_id") == user_id) & is_open("status"))
    return mine.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("held"))


def browse(snap: Snapshot, user_id: int) -> DataFrame:
    shelf = snap.books.join(_held_by(snap, user_id), "id", "left")
    return (
        _with_genre_name(shelf, snap)
        .select(
            *snap.books.columns, "genre_name", F.coalesce("held", F.lit(0)).alias("i_have_it")
        )
        .orderBy(ci("title"), "id")
    )


def browse_members(snap: Snapshot, user_ids: list[int]) -> DataFrame:
    """The shelf as each of some members sees it, whether there are loans to them or not.

    The list is an argument, so a row per book and member of it; books meet loans on book and member.
    """
    listed = F.array(*(F.lit(user_id).cast("long") for user_id in sorted(set(user_ids))))
    mine = snap.tables.borrows.where(F.col("user_id").isin(*user_ids) & is_open("status"))
    held = mine.groupBy(F.col("user_id").alias("member"), F.col("book_id").alias("id")).agg(F.count("*").alias("held"))
    shelf = _with_genre_name(snap.books.withColumn("member", F.explode(listed)), snap).join(held, ["member", "id"], "left")
    return shelf.select("member", *snap.books.columns, "genre_name", F.coalesce("held", F.lit(0)).alias("i_have_it")).orderBy("member", ci("title"), "id")


def browse_display(snap: Snapshot, user_id: int) -> DataFrame:
    return browse(snap, user_id).select(
        "*",
        d.stock_text("quantity").alias("stock_text"),
        d.action_text(F.col("i_have_it") > 0, "quantity").alias("action_text"),
    )


def borrowable(snap: Snapshot, user_id: int) -> DataFrame:
    """Books the member may borrow now: in stock and not already out to them."""
    return (
        snap.books.where(F.col("quantity") > 0)
        .join(_held_by(snap, user_id), "id", "left_anti")
        .select("id", "quantity")
    )


def admin_dashboard(snap: Snapshot) -> dict[str, DataFrame]:
    """All reports of the administration page, by name."""
    reports = (
        kpi_summary,
        overdue_top,
        due_soon,
        active_borrows,
        catalogue,
        genre_catalogue,
        user_stats,
        borrow_history,
        top_books,
        never_borrowed,
        genre_stats,
        genre_list,
    )
    return {report.__name__: report(snap) for report in reports}


def member_page(snap: Snapshot, user_id: int) -> dict[str, DataFrame]:
    """Both reports of a member's page, by name."""
    return {"my_borrows": my_borrows(snap, user_id), "browse": browse(snap, user_id)}

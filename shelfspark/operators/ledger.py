"""Replay of ordered borrow and return requests against stock.

A borrow is admitted when the book has a copy on the shelf and no loan of the
member's is open by status; a return when the loan it names is the member's and
has no return time yet, whatever its status says.  Both rules read
one book's stock and that book's open loans only, so books are independent, but
within a book every answer may depend on all earlier ones.  How the requests of
many and of very busy books are spread over tasks is told in
``shelfspark.operators.slices``.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.loans import due_date, is_open
from shelfspark.operators import slices
from shelfspark.operators.book_state import BORROW, RETURN_HELD, RETURN_LOAN, RETURN_LOOSE
from shelfspark.operators.requests import counters_after, message, next_keys, outcome_rows, with_permission
from shelfspark.schema import BOOKS, BORROWS, USER, conform
from shelfspark.session import work_folder, write_and_reread
from shelfspark.tables import Tables

# A busy book's requests are cut into slices of so many.
SLICE_ROWS = 1_000_000


@dataclasses.dataclass(frozen=True)
class Replay:
    """Answers in full, the changes they amount to, and the tables after them.

    ``opened``, ``closed`` and ``stock_delta`` hold what changed, for sinks
    that apply changes; ``tables`` is the complete new state.  ``answers`` are
    the requests that were asked, with their book.
    """

    tables: Tables
    outcomes: DataFrame
    opened: DataFrame
    closed: DataFrame
    stock_delta: DataFrame
    answers: DataFrame


def micros(ts: Column | str) -> Column:
    """A zone-free timestamp as microseconds since 1970, whatever the session's zone."""
    day_us, hour_us, minute_us = 86_400_000_000, 3_600_000_000, 60_000_000
    seconds = F.date_part(F.lit("SECOND"), ts) * 1_000_000
    return (
        F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * day_us
        + F.hour(ts).cast("long") * hour_us
        + F.minute(ts).cast("long") * minute_us
        + seconds.cast("long")
    )


def timestamp(at_us: Column | str) -> Column:
    """The inverse of ``micros``."""
    at_us = F.col(at_us) if isinstance(at_us, str) else at_us
    seconds = (at_us.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def judge(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with their time in microseconds and whether the asking user may lend."""
    judged = with_permission(requests, users, USER).withColumn("at_us", micros("ts"))
    return judged.select("request_id", "at_us", "user_id", "kind", "permitted", "book_id", "borrow_id")


def resolve(tables: Tables, judged: DataFrame, new_loan_id: Column, folder: str) -> DataFrame:
    """Judged requests with the book they concern, the loan they open or name, or why not.

    A return may name a loan that a borrow of the same batch opens; it is told the
    book here, and whether that borrow came before it and was admitted by the replay.

    Returns that name a loan are joined apart from the rest: the others have no
    loan to join on and would all meet in the partition of NULL.  These are written to ``folder``; the others are as they were judged.
    """
    kept = ["request_id", "at_us", "user_id", "kind", "permitted"]
    names_loan = (F.col("kind") == "return") & F.col("borrow_id").isNotNull()
    plain = judged.where(~names_loan).select(
        *kept,
        "book_id",
        F.when(F.col("kind") == "borrow", BORROW).otherwise(RETURN_HELD).alias("code"),
        F.when(F.col("kind") == "borrow", new_loan_id)
        .otherwise(F.lit(0).cast("long"))
        .alias("loan_id"),
    )
    out = tables.borrows.where(F.col("returned_at").isNull()).select(
        F.col("id").alias("borrow_id"),
        F.col("user_id").alias("owner"),
        F.col("book_id").alias("loan_book_id"),
        (~F.coalesce(is_open("status"), F.lit(False))).alias("loose"),
    )
    opening = judged.where((F.col("kind") == "borrow") & F.col("permitted"))
    out = out.unionByName(
        opening.select(
            new_loan_id.alias("borrow_id"),
            F.col("user_id").alias("owner"),
            F.col("book_id").alias("loan_book_id"),
            F.lit(False).alias("loose"),
        )
    )
    named = (
        judged.where(names_loan)
        .join(out, "borrow_id", "left")
        .select(
            *kept,
            F.when(F.col("owner") == F.col("user_id"), F.col("loan_book_id")).alias("book_id"),
            F.when(F.col("loose"), RETURN_LOOSE).otherwise(RETURN_LOAN).alias("code"),
            F.col("borrow_id").alias("loan_id"),
        )
    )
    return plain.unionByName(write_and_reread(named, folder)).withColumn(
        "refusal",
        F.when(~F.col("permitted"), "forbidden")
        .when(~F.col("kind").isin("borrow", "return"), "unknown_kind")
        .when(F.col("book_id").isNull(), "no_such_loan"),
    )


def _loose_once(resolved: DataFrame) -> DataFrame:
    """Refuses all but the first return of each loan that is out though its status is not open.

    Such a loan blocks no borrow, so its first return holds whatever else is asked.
    """
    loose = (F.col("code") == RETURN_LOOSE) & F.col("refusal").isNull()
    order = F.struct("at_us", "request_id")
    first = resolved.where(loose).groupBy("loan_id").agg(F.min(order).alias("first"))
    judged = resolved.where(loose).join(first, "loan_id")
    again = F.when(F.col("first") != order, "no_such_loan")
    return resolved.where(~loose).unionByName(judged.withColumn("refusal", again).drop("first"))


def replay(
    tables: Tables,
    requests: DataFrame,
    slice_rows: int = SLICE_ROWS,
    reuse: bool = True,
    new_loan_id: Column | None = None,
) -> Replay:
    """Answer all requests in the order (ts, request_id), and apply the admitted.

    ``requests`` follow ``LEDGER_REQUEST``.  A return names a loan, or else the
    book, which stands for the member's open loan of it.  With ``reuse`` the
    answers are written once for all results; without, each result derives the
    answers of ordinary books anew.  ``new_loan_id`` is the key of the loan a
    borrow opens, by default the next free ones.
    """
    folder = work_folder(requests.sparkSession)
    # Whatever gives the requests is derived once: they are read for their keys and for each way to find their book.
    judged = write_and_reread(judge(requests, tables.users), f"{folder}/requests")
    if new_loan_id is None:
        new_loan_id = next_keys(tables, "borrows", judged)
    resolved = resolve(tables, judged, new_loan_id, f"{folder}/named")
    resolved = _loose_once(resolved)
    events = resolved.where(F.col("refusal").isNull()).drop("refusal", "permitted", "kind")
    answers = slices.answer(tables, events, slice_rows)
    if reuse:
        answers = write_and_reread(answers, f"{folder}/answers")
    span = judged.agg((F.max("request_id") - F.min("request_id") + 1).alias("n")).scalar()
    counters = counters_after(tables, borrows=F.coalesce(span, F.lit(0)))
    return _apply(tables.replace(counters=counters), resolved, answers)


def answer_outcomes(answers: DataFrame, resolved: DataFrame) -> DataFrame:
    """One outcome per request: the answers, and the reasons of those never asked."""
    borrowing = F.col("code") == BORROW
    outcome = (
        F.when(borrowing & F.col("accepted"), "borrowed")
        .when(borrowing, "unavailable")
        .when(F.col("accepted"), "returned")
        .otherwise("no_such_loan")
    )
    unasked = F.when(
        (F.col("refusal") == "no_such_loan") & borrowing, "unavailable"
    ).otherwise(F.col("refusal"))
    judged = answers.select("request_id", "at_us", outcome.alias("outcome")).unionByName(
        resolved.where(F.col("refusal").isNotNull()).select(
            "request_id", "at_us", unasked.alias("outcome")
        )
    )
    return outcome_rows(
        judged,
        {
            "borrowed": message("borrowed", due_date(timestamp("at_us"))),
            "unavailable": message("unavailable"),
            "returned": message("returned"),
        },
    )


def _apply(tables: Tables, resolved: DataFrame, answers: DataFrame) -> Replay:
    borrowing = F.col("code") == BORROW
    answers = answers.withColumn("ts", timestamp("at_us"))
    admitted = answers.where("accepted")
    opened = conform(
        admitted.where(borrowing).select(
            F.col("loan_id").alias("id"),
            "user_id",
            "book_id",
            F.col("ts").alias("borrowed_at"),
            due_date("ts").alias("due_date"),
            F.lit(None).cast("timestamp_ntz").alias("returned_at"),
            F.lit("active").alias("status"),
        ),
        BORROWS,
    )
    closed = admitted.where(~borrowing).select(
        F.col("loan_id").alias("id"), F.col("ts").alias("closed_at")
    )
    stock_delta = admitted.groupBy("book_id").agg(
        F.sum(F.when(borrowing, -1).otherwise(1)).alias("delta")
    )
    books = tables.books.join(
        stock_delta.withColumnRenamed("book_id", "id"), "id", "left"
    ).withColumn("quantity", F.col("quantity") + F.coalesce("delta", F.lit(0)))
    returned = F.col("closed_at").isNotNull()
    borrows = (
        tables.borrows.unionByName(opened)
        .join(closed, "id", "left")
        .withColumn("returned_at", F.coalesce("closed_at", "returned_at"))
        .withColumn("status", F.when(returned, "returned").otherwise(F.col("status")))
    )
    outcomes = answer_outcomes(answers, resolved)
    state = tables.replace(books=conform(books, BOOKS), borrows=conform(borrows, BORROWS))
    return Replay(state, outcomes, opened, closed, stock_delta, answers)

"""Answers for books whose stock cannot run out, by Spark's own expressions.

A borrow takes at most one copy, so a book with as many copies as borrow requests never runs out, whatever comes back.
There the answers to a member depend on that member's own requests alone: a fold over them in order, from the loans of the
book that the member held before, kept as an array.  No Python takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.book_state import BORROW, RETURN_HELD, RETURN_LOOSE, STUCK

ANSWER = ("request_id", "book_id", "user_id", "at_us", "code", "loan_id", "accepted")
# A book with more requests is replayed in Python: the fold copies a member's answers with every request.
FOLDED_ROWS = 2000
_STATE = "struct<held: array<bigint>, answers: array<struct<at_us: bigint, request_id: bigint, code: int, loan_id: bigint, accepted: boolean>>>"


def cannot_run_out(quantity: Column, borrows: Column, requests: Column) -> Column:
    """Whether a book's requests can be folded member by member."""
    return (F.coalesce(quantity, F.lit(0)) >= borrows) & (requests <= FOLDED_ROWS)


def _step(state: Column, asked: Column) -> Column:
    """The lending rule without stock, applied to one request."""
    held, code = state["held"], asked["code"]
    due = F.filter(held, lambda loan: loan != STUCK)
    closed = F.when(code == RETURN_HELD, F.get(due, F.lit(0))).otherwise(asked["loan_id"])
    accepted = (
        F.when(code == BORROW, F.size(held) == 0)
        .when(code == RETURN_LOOSE, F.lit(True))
        .otherwise(F.coalesce(F.array_contains(due, closed), F.lit(False)))
    )
    left = (
        F.when(~accepted | (code == RETURN_LOOSE), held)
        .when(code == BORROW, F.array(asked["loan_id"]))
        .otherwise(F.filter(held, lambda loan: loan != closed))
    )
    answer = F.struct(
        asked["at_us"].alias("at_us"),
        asked["request_id"].alias("request_id"),
        code.alias("code"),
        F.when(accepted, closed).otherwise(F.lit(0).cast("long")).alias("loan_id"),
        accepted.alias("accepted"),
    )
    return F.struct(left.alias("held"), F.concat(state["answers"], F.array(answer)).alias("answers")).cast(_STATE)


def fold_members(events: DataFrame, blocking: DataFrame) -> DataFrame:
    """The ``ANSWER`` to each of ``events``, all of books that ``cannot_run_out``; ``blocking`` are the loans before."""
    asked = F.sort_array(F.collect_list(F.struct("at_us", "request_id", "code", "loan_id")))
    members = events.groupBy("book_id", "user_id").agg(asked.alias("asked"))
    before = blocking.groupBy("book_id", "user_id").agg(F.sort_array(F.collect_list("id")).alias("held"))
    start = F.struct(F.coalesce("held", F.array().cast("array<bigint>")).alias("held"), F.array().alias("answers")).cast(_STATE)
    folded = members.join(before, ["book_id", "user_id"], "left").select(
        "book_id", "user_id", F.explode(F.aggregate("asked", start, _step, lambda state: state["answers"])).alias("answer")
    )
    return folded.select("book_id", "user_id", "answer.*").select(*ANSWER)

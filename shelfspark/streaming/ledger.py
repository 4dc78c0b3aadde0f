"""The ledger over an endless stream of requests, answered in order of arrival.

A streaming query records which trigger brought each request.  Every recorded trigger is then a
batch replay on the state its predecessors left, so a busy book is split there as in a batch, and it is answered while
later requests still arrive.

The state grows by changes.  A trigger writes what it changed and nothing else: the loans it opened and left out, the
loans it closed, the books it was asked for.  The state is the tables before the stream, the last compaction,
and the changes since; every ``compact_every`` triggers they are folded into the next compaction.  Counted over many triggers
a request is so written a bounded number of times, however long the stream runs.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.book_state import BORROW
from shelfspark.operators.ledger import SLICE_ROWS, Replay, replay
from shelfspark.operators.requests import next_free
from shelfspark.schema import BORROWS, LEDGER_REQUEST, conform
from shelfspark.session import path_exists
from shelfspark.tables import Tables

_ARRIVED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER_REQUEST) + ", trigger long"
# What a trigger changes: loans it opened that are still out, loans it closed that are older, and
# for each book asked for how its stock changed and its latest answered request.
_CHANGES = {
    "opened": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BORROWS),
    "closed": "id long",
    "books": "book_id long, delta long, at_us long, request_id long",
}
_ANSWERED = "trigger long, compacted long"
_BEFORE = -1
COMPACT_EVERY = 16


def _record(requests: DataFrame, folder: str, **trigger: object) -> StreamingQuery:
    """Starts to write each request with the number of the trigger that brought it."""

    def with_trigger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A trigger that runs again after a failure keeps its number.
        number = int(TaskContext.get().getLocalProperty("streaming.sql.batchId"))
        for batch in batches:
            yield batch.append_column("trigger", pa.array([number] * batch.num_rows, pa.int64()))

    return (
        conform(requests, LEDGER_REQUEST)
        .mapInArrow(with_trigger, _ARRIVED)
        .writeStream.format("parquet")
        .partitionBy("trigger")
        .option("path", f"{folder}/arrived")
        .option("checkpointLocation", f"{folder}/progress")
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def answer_arrivals(
    tables: Tables,
    requests: DataFrame,
    folder: str,
    slice_rows: int = SLICE_ROWS,
    compact_every: int = COMPACT_EVERY,
    every: str | None = None,
) -> None:
    """Answer the requests of a stream into ``folder``/outcomes, trigger by trigger, while it runs.

    Without ``every`` all requests that are there now are taken; with it (an interval such as ``"1 minute"``) the
    stream goes on until it is stopped.  Requests apply in order of arrival: by trigger, then (ts, request_id).  None is refused for
    its age; ``late`` tells that an earlier trigger had answered a later request for the same book.  ``tables`` are the state before the
    stream.  New loans are numbered on from their first free loan key by request_id, so those start at 0 or above; a return may
    name such a loan without its book.

    Outcomes are written after the changes, and the mark that a trigger is answered last of all: a trigger cut
    off is answered again with the same result, one answered is not.  A later call with the same folder goes on.
    """
    query = _record(requests, folder, **({"processingTime": every} if every else {"availableNow": True}))
    ledger = ArrivalLedger(tables, folder, slice_rows, compact_every)
    try:
        while query.isActive:
            if not ledger.answer_recorded():
                query.awaitTermination(1)
        query.awaitTermination()
        ledger.answer_recorded()
    finally:
        query.stop()


class ArrivalLedger:
    """Answers recorded triggers one after another, and keeps the state as a log of changes under ``folder``."""

    def __init__(self, tables: Tables, folder: str, slice_rows: int = SLICE_ROWS, compact_every: int = COMPACT_EVERY):
        self.spark: SparkSession = tables.books.sparkSession
        self.tables, self.folder = tables, folder
        self.slice_rows, self.compact_every = slice_rows, compact_every
        # All triggers answered since the last compaction, and the number of that.
        self.since: list[int] = []
        self.compacted = _BEFORE
        if path_exists(self.spark, f"{folder}/answered"):
            marks = self.spark.read.schema(_ANSWERED).parquet(f"{folder}/answered")
            self.compacted = marks.agg(F.max("compacted")).first()[0]
            later = marks.where(F.col("trigger") > self.compacted).select("trigger").distinct()
            self.since = sorted(row.trigger for row in later.collect())
        self.first_key = self.spark.range(1).select(next_free(tables, "borrows")).first()[0]

    def answer_recorded(self) -> int:
        """Answers the triggers recorded by now; how many there were."""
        if not path_exists(self.spark, f"{self.folder}/arrived/_spark_metadata"):
            return 0
        arrived = self.spark.read.schema(_ARRIVED).parquet(f"{self.folder}/arrived")
        last = self.since[-1] if self.since else self.compacted
        # One number per trigger that waits.
        waiting = arrived.where(F.col("trigger") > last).select("trigger").distinct()
        numbers = sorted(row.trigger for row in waiting.collect())
        for number in numbers:
            self._answer(number, arrived.where(F.col("trigger") == number).drop("trigger"))
        return len(numbers)

    def state(self) -> dict[str, DataFrame]:
        """What all answered triggers changed: loans they opened that are out, older loans they closed, books."""
        parts = {}
        for name, columns in _CHANGES.items():
            paths = [f"{self.folder}/changes/{name}/trigger={number}" for number in self.since]
            if self.compacted != _BEFORE:
                paths.append(f"{self.folder}/compacted/upto={self.compacted}/{name}")
            parts[name] = self.spark.read.schema(columns).parquet(*paths) if paths else self.spark.createDataFrame([], columns)
        books = parts["books"].groupBy("book_id").agg(F.sum("delta").alias("delta"), F.max(F.struct("at_us", "request_id")).alias("last"))
        return {
            "opened": parts["opened"].join(parts["closed"], "id", "left_anti"),
            "closed": parts["closed"].where(F.col("id") < self.first_key),
            "books": books.select("book_id", "delta", "last.at_us", "last.request_id"),
        }

    def _answer(self, number: int, asked: DataFrame) -> None:
        state = self.state()
        key = (F.lit(self.first_key) + F.col("request_id")).cast("long")
        answered = replay(_tables_after(self.tables, state), asked, self.slice_rows, new_loan_id=key)
        for name, rows in _changes_of(answered).items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/changes/{name}/trigger={number}")
        outcomes = _with_lateness(answered, state["books"])
        outcomes.write.mode("overwrite").parquet(f"{self.folder}/outcomes/trigger={number}")
        self.since.append(number)
        self._mark(number)
        if len(self.since) >= self.compact_every:
            self._compact(number)

    def _mark(self, number: int) -> None:
        mark = self.spark.createDataFrame([(number, self.compacted)], _ANSWERED)
        mark.coalesce(1).write.mode("append").parquet(f"{self.folder}/answered")

    def _compact(self, number: int) -> None:
        """Folds the changes so far into one table each; the mark makes it count."""
        for name, rows in self.state().items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/compacted/upto={number}/{name}")
        self.compacted, self.since = number, []
        self._mark(number)


def _changes_of(answered: Replay) -> dict[str, DataFrame]:
    asked = answered.answers.groupBy("book_id").agg(
        F.sum(F.when(~F.col("accepted"), 0).when(F.col("code") == BORROW, -1).otherwise(1)).cast("long").alias("delta"),
        F.max(F.struct("at_us", "request_id")).alias("last"),
    )
    return {
        "opened": answered.opened.join(answered.closed.select("id"), "id", "left_anti"),
        "closed": answered.closed.select("id").join(answered.opened.select("id"), "id", "left_anti"),
        "books": asked.select("book_id", "delta", "last.at_us", "last.request_id"),
    }


def _tables_after(tables: Tables, left: dict[str, DataFrame]) -> Tables:
    """The tables before the stream with what its triggers changed; loans that came back are left out."""
    delta = left["books"].select(F.col("book_id").alias("id"), "delta")
    quantity = (F.col("quantity") + F.coalesce("delta", F.lit(0))).cast("int")
    books = tables.books.join(delta, "id", "left").withColumn("quantity", quantity).drop("delta")
    borrows = tables.borrows.join(left["closed"], "id", "left_anti")
    return tables.replace(books=books, borrows=conform(borrows, BORROWS).unionByName(left["opened"]))


def _with_lateness(answered: Replay, books: DataFrame) -> DataFrame:
    last = books.select("book_id", F.struct("at_us", "request_id").alias("last"))
    late = (
        answered.answers.select("book_id", "request_id", F.struct("at_us", "request_id").alias("own"))
        .join(last, "book_id")
        .where(F.col("own") < F.col("last"))
        .select("request_id", F.lit(True).alias("late"))
        .distinct()
    )
    noted = answered.outcomes.join(late, "request_id", "left")
    return noted.withColumn("late", F.coalesce("late", F.lit(False)))

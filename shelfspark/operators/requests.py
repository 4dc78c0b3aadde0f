"""What the change operators share: roles, order within a batch, keys, outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.schema import TABLES
from shelfspark.session import work_folder, write_and_reread
from shelfspark.tables import Tables

# The answer texts.  ``{}`` stands for the value in question.
MESSAGES = {
    "registered": "Account created! You can now log in.",
    "taken": "Username already taken.",
    "denied": "Invalid username or password.",
    "book_added": 'Book "{}" added.',
    "book_updated": "Book updated.",
    "book_deleted": "Book deleted.",
    "genre_added": 'Genre "{}" added.',
    "genre_exists": "Genre already exists.",
    "genre_deleted": "Genre deleted. Affected books set to no genre.",
    "borrowed": "Book borrowed! Due back on {}.",
    "unavailable": "Book unavailable or you already have it borrowed.",
    "returned": "Book returned successfully. Thank you!",
}


class Change:
    """The new state, and one outcome row per request.

    New keys take a job, so the state may be given as a function; it is called when the state is first asked for.
    """

    def __init__(self, tables: Tables | Callable[[], Tables], outcomes: DataFrame):
        self._tables, self.outcomes = tables, outcomes

    @property
    def tables(self) -> Tables:
        if callable(self._tables):
            self._tables = self._tables()
        return self._tables


def message(name: str, value: Column | None = None) -> Column:
    text = MESSAGES[name]
    if value is None:
        return F.lit(text)
    before, after = text.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def outcome_rows(judged: DataFrame, messages: dict[str, Column], *extra: str) -> DataFrame:
    """(request_id, outcome, message); outcomes without a message stay silent."""
    text = F.lit("")
    for code, shown in messages.items():
        text = F.when(F.col("outcome") == code, shown).otherwise(text)
    return judged.select("request_id", "outcome", text.alias("message"), *extra)


def with_permission(requests: DataFrame, users: DataFrame, role: str) -> DataFrame:
    """Adds ``permitted``: the requesting user exists and has exactly ``role``.

    A user who sends a large share of all requests skews this join; users are
    unique, so the adaptive skew join splits that user's requests.
    """
    holders = users.where(F.col("role") == role).select(
        F.col("id").alias("user_id"), F.lit(True).alias("permitted")
    )
    return requests.join(holders, "user_id", "left").withColumn(
        "permitted", F.coalesce("permitted", F.lit(False))
    )


def role_gate(requests: DataFrame, users: DataFrame, role: str) -> DataFrame:
    judged = with_permission(requests, users, role).withColumn(
        "outcome", F.when(F.col("permitted"), "permitted").otherwise("forbidden")
    )
    return outcome_rows(judged, {})


def first_per_key(requests: DataFrame, key: str) -> DataFrame:
    """(key, request_id) of the earliest request per key.

    An aggregate, not a window: each task first reduces its own rows, so a key
    with a third of all requests sends one row per task through the shuffle.
    """
    first = requests.groupBy(key).agg(F.min(F.struct("ts", "request_id")).alias("first"))
    return first.select(key, F.col("first.request_id").alias("request_id"))


def next_free(tables: Tables, name: str) -> Column:
    """The key that the next row of a table gets: above all present ones, and above those its counter has given."""
    top = F.coalesce(getattr(tables, name).agg(F.max("id")).scalar(), F.lit(0)).cast("long") + 1
    if tables.counters is None:
        return top
    given = tables.counters.where(F.col("tbl") == name).agg(F.max("next_id")).scalar()
    return F.greatest(top, F.coalesce(given, F.lit(1).cast("long")))


def counters_after(tables: Tables, **used: Column | int) -> DataFrame:
    """The counters of all tables, those named moved on by so many keys.

    Deletions name their table with 0: its counter must not fall back with the rows.
    """
    spark = tables.books.sparkSession
    rows = [
        F.struct(F.lit(name).alias("tbl"), (next_free(tables, name) + F.lit(used.get(name, 0))).cast("long").alias("next_id"))
        for name in TABLES
        if name in used or tables.counters is not None
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def next_keys(tables: Tables, name: str, requests: DataFrame) -> Column:
    """Keys on from the table's counter by the distance of request ids: unique, rising with request_id, with gaps.

    Needs neither a window nor a shuffle.  Request ids may be anything, as long as the distance between two of
    them fits 64 bits together with the keys.
    """
    first = requests.agg(F.min("request_id")).scalar()
    return (next_free(tables, name) + (F.col("request_id") - first)).cast("bigint")


def numbered(df: DataFrame, order: list[str], **which: Column) -> DataFrame:
    """Adds for each name the place, from 1, among the rows that meet its condition; null for other rows.

    The rows are range-partitioned by ``order`` and written once; a place is the number of such rows in earlier partitions plus
    those before it in its own.  Only the counts, one row per partition, pass through a single task.
    """
    flags = [F.coalesce(met, F.lit(False)).cast("int").alias(name) for name, met in which.items()]
    ranged = df.select("*", *flags).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    kept = write_and_reread(ranged, work_folder(df.sparkSession))
    counts = kept.groupBy("__part").agg(*(F.sum(name).alias(name) for name in which))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("__part", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"__{name}") for name in which))
    upto = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    places = {name: F.when(F.col(name) == 1, F.col(f"__{name}") + F.sum(name).over(upto)) for name in which}
    return kept.join(F.broadcast(before), "__part").withColumns(places).drop("__part", *(f"__{name}" for name in which))


def dense_keys(df: DataFrame, order: list[Column], base: Column, name: str = "id") -> DataFrame:
    """Adds keys base+1, base+2, … in ``order``, without a gap, at any size.

    The rows are range-partitioned and written once; each key is the number of
    rows in earlier partitions plus the position within its own.  Only the
    per-partition counts, one row per partition, pass through a single task.
    """
    ranged = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    kept = write_and_reread(ranged, work_folder(df.sparkSession))
    counts = kept.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select(
        "part",
        F.coalesce(
            F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    place = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return (
        kept.withColumn("place", place)
        .join(before, "part")
        .withColumn(name, base + F.col("before") + F.col("place"))
        .drop("part", "place", "before")
    )

"""Snapshots that take changes: a replay rewrites the partitions it touched and leaves the others alone.

Loans lie by status and by the period (a month) they were taken in, which is a range of their keys as keys rise with time; books
lie by ranges of keys.  A loan that comes back moves from one status to another within its period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.ledger import Replay
from shelfspark.operators.requests import counters_after
from shelfspark.schema import BOOKS, BORROWS, TABLES, conform
from shelfspark.session import delete_path, work_folder, write_and_reread
from shelfspark.sources.files import COUNTERS, read_tables
from shelfspark.tables import Tables

BOOK_KEYS = 100_000
# How a period is named; a snapshot keeps to one pattern.
MONTHS = "yyyy-MM"
LOAN_PARTS, BOOK_PARTS = ("status", "period"), ("keys",)
_SCHEMAS = {"borrows": (BORROWS, "period string"), "books": (BOOKS, "keys long")}


def _laid_out(loans: DataFrame, periods: str) -> DataFrame:
    return conform(loans, BORROWS).withColumn("period", F.date_format("borrowed_at", periods))


def _in_ranges(books: DataFrame) -> DataFrame:
    return conform(books, BOOKS).withColumn("keys", F.floor(F.col("id") / BOOK_KEYS))


def write_ranges(tables: Tables, folder: str, periods: str = MONTHS) -> None:
    """Write a snapshot that takes changes into a new folder; an existing one is an error.

    Rows of a partition go to few files, and a partition with a large share of all rows to several, as its size asks for.
    """
    laid_out = {"borrows": (_laid_out(tables.borrows, periods), LOAN_PARTS), "books": (_in_ranges(tables.books), BOOK_PARTS)}
    for name, schema in TABLES.items():
        df, parts = laid_out.get(name, (conform(getattr(tables, name), schema), ()))
        df = df.hint("rebalance", *parts) if parts else df
        df.write.mode("errorifexists").partitionBy(*parts).parquet(f"{folder}/{name}")
    # The highest keys are those of the written tables, which are cheap to read.
    written = {name: tables.books.sparkSession.read.schema("id long").parquet(f"{folder}/{name}") for name in TABLES}
    counters = counters_after(tables.replace(**written), **dict.fromkeys(TABLES, 0))
    counters.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/counters")


def read_ranges(spark: SparkSession, folder: str) -> Tables:
    """The tables that ``write_ranges`` and ``apply_replay`` left under ``folder``."""
    plain = read_tables(spark, folder)
    return plain.replace(**{name: conform(_with_parts(spark, folder, name), TABLES[name]) for name in _SCHEMAS})


def _with_parts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema, part = _SCHEMAS[name]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{fields}, {part}").parquet(f"{folder}/{name}")


def _any_of(parts: list[tuple], names: tuple[str, ...]) -> Column:
    """A filter on partition columns alone, so that other partitions are not read."""
    by_first: dict = {}
    for first, *rest in parts:
        by_first.setdefault(first, []).extend(rest)
    met = F.lit(False)
    if len(names) == 1:
        return F.col(names[0]).isin([first for first, in parts]) if parts else met
    for first, rest in by_first.items():
        met = met | ((F.col(names[0]) == first) & F.col(names[1]).isin(rest))
    return met


def _rewrite(rows: DataFrame, folder: str, name: str, names: tuple[str, ...], touched: list[tuple]) -> None:
    """Puts ``rows`` in place of the partitions ``touched``; those that have no row any more go."""
    spark = rows.sparkSession
    kept = write_and_reread(rows, work_folder(spark))
    left = {tuple(row) for row in kept.select(*names).distinct().collect()}
    kept.hint("rebalance", *names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(f"{folder}/{name}")
    for part in touched:
        if part not in left:
            delete_path(spark, f"{folder}/{name}/" + "/".join(f"{n}={value}" for n, value in zip(names, part, strict=True)))


def apply_replay(before: Tables, replay: Replay, folder: str, periods: str = MONTHS) -> dict[str, list[tuple]]:
    """Brings the snapshot in ``folder``, read as ``before`` and replayed, to the state after; returns the partitions it rewrote.

    The new rows of all touched partitions are written apart first and then put in place, loans before books before counters.
    There is no transaction over the tables: readers wait until it is done, and a run cut off in between is
    repeated from a copy of the snapshot.  The driver holds one entry per touched partition, at most one per status and period.
    """
    spark = before.books.sparkSession
    closed = replay.closed.select("id", "closed_at")
    stored = _with_parts(spark, folder, "borrows")
    back = F.col("closed_at").isNotNull()
    ended = {"returned_at": F.coalesce("closed_at", "returned_at"), "status": F.when(back, "returned").otherwise(F.col("status"))}
    from_part = F.struct(*LOAN_PARTS)
    was = stored.where(F.col("returned_at").isNull()).join(closed, "id").withColumn("was", from_part)
    opened = replay.opened.join(closed, "id", "left").withColumn("was", F.lit(None))
    ended_loans = was.drop("period").unionByName(opened).withColumns(ended).withColumn("period", F.date_format("borrowed_at", periods))
    changed = write_and_reread(ended_loans.select(*[F.col(f.name).cast(f.dataType) for f in BORROWS], "period", "was"), work_folder(spark))
    parts = changed.where("was is not null").select("was.*").union(changed.select(*LOAN_PARTS)).distinct()
    loans = sorted(tuple(row) for row in parts.collect())
    stays = stored.where(_any_of(loans, LOAN_PARTS)).join(closed.select("id"), "id", "left_anti")
    deltas = write_and_reread(replay.stock_delta.where(F.col("delta") != 0).withColumnRenamed("book_id", "id"), work_folder(spark))
    # A replay adds loans and no books; their keys need none of the joins that give the state after it.
    keyed = replay.tables.replace(books=before.books, borrows=before.borrows.select("id").union(replay.opened.select("id")))
    counters = [tuple(row) for row in counters_after(keyed, **dict.fromkeys(TABLES, 0)).collect()]
    _rewrite(stays.select(*BORROWS.names, "period").unionByName(changed.drop("was")), folder, "borrows", LOAN_PARTS, loans)

    shelved = _with_parts(spark, folder, "books")
    ranges = deltas.join(shelved.select("id", "keys"), "id").select("keys").distinct()
    books = sorted(tuple(row) for row in ranges.collect())
    stock = (F.col("quantity") + F.coalesce("delta", F.lit(0))).cast("int")
    restocked = shelved.where(_any_of(books, BOOK_PARTS)).join(deltas, "id", "left").withColumn("quantity", stock)
    _rewrite(restocked.select(*BOOKS.names, "keys"), folder, "books", BOOK_PARTS, books)
    spark.createDataFrame(counters, COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counters")
    return {"borrows": loans, "books": books}

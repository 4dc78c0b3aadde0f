"""Table snapshots on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.operators.requests import counters_after
from shelfspark.schema import REQUESTS, TABLES, conform
from shelfspark.session import path_exists
from shelfspark.tables import Tables


COUNTERS = "tbl string, next_id long"


def read_tables(spark: SparkSession, folder: str) -> Tables:
    """The tables ``write_tables`` left under ``folder``, with their key counters where there are any."""
    path = f"{folder}/counters"
    return Tables(
        counters=spark.read.schema(COUNTERS).parquet(path) if path_exists(spark, path) else None,
        **{
            name: spark.read.schema(schema).parquet(f"{folder}/{name}")
            for name, schema in TABLES.items()
        },
    )


def write_tables(tables: Tables, folder: str, by_member: bool = False) -> None:
    """Write a snapshot into a new folder; an existing one is an error.

    Operators are lazy, so writing over the folder a plan still reads would
    destroy its input.  Loans are laid out by status: reports on open loans
    then skip the returned ones, which make up most of a long history.  With
    ``by_member`` each status is also sorted by member, at the price of one
    shuffle, so that one member's loans lie in a few files whose statistics let
    a scan skip the rest; the loan key in the order splits busy members.
    """
    counters = counters_after(tables, **dict.fromkeys(TABLES, 0))
    counters.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/counters")
    for name, schema in TABLES.items():
        df = conform(getattr(tables, name), schema)
        if name == "borrows":
            if by_member:
                order = ("status", "user_id", "id")
                df = df.repartitionByRange(*order).sortWithinPartitions(*order)
            df.write.mode("errorifexists").partitionBy("status").parquet(f"{folder}/{name}")
        else:
            df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def read_requests(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(REQUESTS[kind]).parquet(folder)


def stream_requests(
    spark: SparkSession, folder: str, kind: str, max_files: int = 1000
) -> DataFrame:
    """Request files as they arrive, at most ``max_files`` in a trigger; how many rows that is depends on the files."""
    return (
        spark.readStream.schema(REQUESTS[kind])
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )

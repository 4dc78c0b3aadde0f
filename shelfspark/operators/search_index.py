"""Substring search by a table of trigrams.

Every three characters in a row of a shown text that are not all blank make a posting (gram, id).  A row that contains a query
has all of the query's trigrams, so the postings of these name the candidates, which are then searched like all rows
otherwise.  Postings lie by hash of the gram and are sorted by it, so a query reads a few files of them and not the
rows.  Queries without such a trigram, those under three characters among them, search all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.search import row_text, search

GRAM = 3
BUCKETS = 16


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, without those of blanks alone."""
    low = F.lower(text)
    places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    found = F.transform(places, lambda i: F.substr(low, i, F.lit(GRAM)))
    return F.filter(F.array_distinct(found), lambda gram: F.btrim(gram, F.lit(" \n")) != "")


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(rows: DataFrame, cells: Sequence[Column], folder: str, key: str = "id") -> DataFrame:
    """The postings (gram, id, bucket) of the texts that ``rows`` show, written into a new folder and read from there."""
    postings = rows.select(F.explode(grams(row_text(cells))).alias("gram"), F.col(key).alias("id")).withColumn("bucket", _bucket(F.col("gram")))
    laid_out = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
    laid_out.write.mode("errorifexists").partitionBy("bucket").parquet(folder)
    return rows.sparkSession.read.schema(postings.schema).parquet(folder)


def candidates(postings: DataFrame, query: str) -> DataFrame | None:
    """The ids that have all trigrams of ``query``; None where it has none to go by."""
    wanted = postings.sparkSession.range(1).select(F.transform(grams(F.lit(query)), lambda g: F.struct(g.alias("gram"), _bucket(g).alias("bucket"))).alias("g")).first().g
    if not wanted:
        return None
    found = postings.where(F.col("bucket").isin(sorted({w.bucket for w in wanted})) & F.col("gram").isin([w.gram for w in wanted]))
    return found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("id")


def search_indexed(rows: DataFrame, cells: Sequence[Column], query: str, postings: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose shown text contains ``query``, as ``search`` finds them; keys are not null and name a row each."""
    possible = candidates(postings, query)
    if possible is not None:
        rows = rows.join(possible.withColumnRenamed("id", key), key, "left_semi")
    return search(rows, cells, query)

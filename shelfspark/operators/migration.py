"""From free-text genres to a genre table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import ci, clean_text
from shelfspark.operators.requests import dense_keys
from shelfspark.schema import BOOKS, GENRES, conform
from shelfspark.tables import Tables


def normalise_genres(legacy_books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, genres): genre keys follow name order, blank genres become NULL.

    Spellings that differ only in case are one genre, named as in the book with
    the lowest id.  The distinct names come from an aggregate, so a genre that
    most books share is reduced before the shuffle.
    """
    named = legacy_books.withColumn("name", F.nullif(clean_text("genre"), F.lit("")))
    spelled = (
        named.where(F.col("name").isNotNull())
        .groupBy(ci("name").alias("name_key"))
        .agg(F.min(F.struct("id", "name")).alias("first"))
        .select(F.col("first.name").alias("name"))
    )
    genres = conform(dense_keys(spelled, [ci("name"), F.col("name")], F.lit(0)), GENRES)
    keys = genres.select(ci("name").alias("name_key"), F.col("id").alias("genre_id"))
    books = named.withColumn("name_key", ci("name")).join(keys, "name_key", "left")
    return conform(books, BOOKS), genres


def tables_from_legacy(legacy_books: DataFrame, borrows: DataFrame, users: DataFrame) -> Tables:
    books, genres = normalise_genres(legacy_books)
    return Tables(books=books, borrows=borrows, genres=genres, users=users)

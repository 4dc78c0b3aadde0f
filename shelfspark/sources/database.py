"""Tables in a relational database, read in parallel by key range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.schema import TABLES, conform
from shelfspark.tables import Tables


def read_database(
    spark: SparkSession, url: str, partitions: int, properties: dict[str, str] | None = None
) -> Tables:
    """The four tables over JDBC, each split into ``partitions`` ranges of ``id``.

    The driver for ``url`` must be on the class path.
    """
    properties = properties or {}

    def bounds(table: str) -> tuple[int, int]:
        query = f"(SELECT MIN(id) AS low, MAX(id) AS high FROM {table}) AS ids"
        low, high = spark.read.jdbc(url, query, properties=properties).first()
        return (low or 0, high or 0)

    def table(name: str) -> DataFrame:
        low, high = bounds(name)
        df = spark.read.jdbc(
            url,
            name,
            column="id",
            lowerBound=low,
            upperBound=high + 1,
            numPartitions=partitions,
            properties={"preferTimestampNTZ": "true", **properties},
        )
        return conform(df, TABLES[name])

    return Tables(**{name: table(name) for name in TABLES})

"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import WorkTables


def components(links: DataFrame, work: WorkTables) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it can reach.

    Each round hangs all neighbours of a node on the smallest of them, first the larger ones, then
    the smaller ones, until every node hangs on its root; the number of rounds grows with the
    logarithm of the component's size.  Minima are partial aggregates and joins are on the node, so
    a node with a third of all links is reduced where it is read and its join may be split.  Null
    ends and loops link nothing.  Rounds are written tables; nothing is gathered on the driver.
    """

    def distinct_links(pairs: DataFrame) -> DataFrame:
        return pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def large_star(links: DataFrame) -> DataFrame:
        both = links.union(links.select("b", "a"))
        low = both.groupBy(F.col("a").alias("k")).agg(F.least("k", F.min("b")).alias("m"))
        return distinct_links(both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small_star(links: DataFrame) -> DataFrame:
        low = links.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        moved = links.join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return distinct_links(moved.union(low.select("k", "m").toDF("a", "b")))

    def state(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    current = work.cut(distinct_links(links.toDF("a", "b")))
    before = state(current)
    while before[0]:
        current = work.cut(small_star(large_star(current)))
        after = state(current)
        if after == before:
            break
        before = after
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())

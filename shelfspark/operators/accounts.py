"""Registration and login checks over a batch of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import ci, clean_text, md5_hex
from shelfspark.operators.requests import (
    Change,
    counters_after,
    first_per_key,
    message,
    next_free,
    numbered,
    outcome_rows,
)
from shelfspark.schema import TEXT_LIMITS, USER, USERS, conform
from shelfspark.tables import Tables


def register_users(tables: Tables, requests: DataFrame) -> Change:
    """New accounts; of several requests for one name the earliest wins."""
    named = requests.select(
        "request_id",
        "ts",
        clean_text("username").alias("username"),
        md5_hex("password").alias("password"),
    ).withColumn("name_key", ci("username"))
    fits = F.length("username") <= TEXT_LIMITS["users"]["username"]
    known = tables.users.select(ci("username").alias("name_key"))
    fresh = (
        first_per_key(named.where(fits), "name_key")
        .join(known, "name_key", "left_anti")
        .select("request_id", F.lit(True).alias("fresh"))
    )
    judged = named.join(fresh, "request_id", "left").withColumn(
        "outcome",
        F.when(F.col("fresh"), "registered").when(~fits, "too_long").otherwise("taken"),
    )

    def registered() -> Tables:
        added = numbered(judged.where("fresh").select("ts", "request_id", "username", "password"), ["ts", "request_id"], n=F.lit(True))
        rows = added.select(
            (next_free(tables, "users") + F.col("n") - 1).alias("id"),
            "username",
            "password",
            F.lit(USER).alias("role"),
            F.col("ts").alias("created_at"),
        )
        counters = counters_after(tables, users=F.coalesce(added.agg(F.max("n")).scalar(), F.lit(0)))
        return tables.replace(users=tables.users.unionByName(conform(rows, USERS)), counters=counters)

    outcomes = outcome_rows(
        judged, {"registered": message("registered"), "taken": message("taken")}
    )
    return Change(registered, outcomes)


def login_audit(users: DataFrame, attempts: DataFrame) -> DataFrame:
    """Whether each attempt names a user and carries that user's password.

    Names compare case-blind, the hash exactly.  Where several users have one name, the one with the
    smallest id counts, so every attempt gets one outcome.
    """
    keyed = attempts.select(
        "request_id", ci(clean_text("username")).alias("name_key"), md5_hex("password").alias("given")
    )
    named = users.select("id", ci("username").alias("name_key"), F.col("password").alias("stored"))
    first = named.groupBy("name_key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = named.join(first, "name_key").where(F.col("id") > F.col("first")).select("id")
    # Joined by id last, so that the join with the attempts has a shuffle of its own and may split a busy name.
    stored = named.join(later, "id", "left_anti").select("name_key", "stored")
    judged = keyed.join(stored, "name_key", "left").withColumn(
        "outcome",
        F.when(F.col("given") == F.col("stored"), "accepted").otherwise("denied"),
    )
    return outcome_rows(judged, {"denied": message("denied")})

"""Declared constraints as data-quality jobs.  Each returns the violating rows.

Keys are counted with aggregates that reduce before the shuffle, so a value
repeated in a third of all rows costs one row per task.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.loans import is_open
from shelfspark.functions.text import ci, clean_int, clean_text
from shelfspark.schema import MIN_PASSWORD_CHARS, STATUSES, TABLES, TEXT_LIMITS
from shelfspark.tables import Tables


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def duplicate_keys(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    """Names equal but for case, accents or trailing spaces; lists the first spelling."""
    return (
        df.groupBy(ci(name).alias("name_key"))
        .agg(F.min(name).alias(name), F.count("*").alias("n"))
        .where("n > 1")
        .select(name, "n")
    )


def missing_values(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.where(_any([F.col(f.name).isNull() for f in schema if not f.nullable]))


def orphans(df: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """Rows whose non-null ``key`` names no parent."""
    ids = parents.select(F.col("id").alias(key))
    return df.where(F.col(key).isNotNull()).join(ids, key, "left_anti").select(df.columns)


def foreign_key_violations(tables: Tables) -> DataFrame:
    """(child, fk, id) over the three declared references."""
    references = [
        ("books", "genre_id", tables.genres),
        ("borrows", "book_id", tables.books),
        ("borrows", "user_id", tables.users),
    ]
    found = [
        orphans(getattr(tables, child).select("id", key), key, parents).select(
            F.lit(child).alias("child"), F.lit(key).alias("fk"), "id"
        )
        for child, key, parents in references
    ]
    return functools.reduce(DataFrame.unionByName, found)


def bad_status(borrows: DataFrame) -> DataFrame:
    return borrows.where(~F.col("status").isin(*STATUSES))


def repeated_open_loans(borrows: DataFrame) -> DataFrame:
    """(user, book) pairs with more than one loan open."""
    return (
        borrows.where(is_open("status"))
        .groupBy("user_id", "book_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )


def too_long(df: DataFrame, table: str) -> DataFrame:
    return df.where(_any([F.length(c) > n for c, n in TEXT_LIMITS[table].items()]))


def restricted_deletes(ids: DataFrame, borrows: DataFrame, key: str) -> DataFrame:
    """Ids that may not be deleted because a loan still refers to them.

    Loans reduce to distinct keys before they meet the ids.
    """
    used = borrows.select(F.col(key).alias("id")).distinct()
    return (
        ids.select("id")
        .distinct()
        .join(used, "id", "left_semi")
        .select("id", F.lit("restricted").alias("outcome"))
    )


def invalid_requests(requests: DataFrame, kind: str) -> DataFrame:
    """Requests the forms would not send: (request_id, outcome, message).

    The server side accepts them all the same, so the change operators do too;
    drop these first to apply the form rules.
    """
    texts = [f.name for f in requests.schema if f.dataType == T.StringType()]
    blank = {name: clean_text(name) == "" for name in texts}
    if kind in ("register", "login"):
        rules = [(blank["username"], "username is required")]
        short = F.length(F.coalesce("password", F.lit(""))) < MIN_PASSWORD_CHARS
        if kind == "register":
            rules.append((short, "password is too short"))
        else:
            rules.append((F.coalesce("password", F.lit("")) == "", "password is required"))
    elif kind in ("add_book", "edit_book"):
        floor = 1 if kind == "add_book" else 0
        # A sign the cleaned number no longer has still breaks the rule.
        negative = F.coalesce(clean_text("quantity").startswith("-"), F.lit(False))
        low = negative | (clean_int("quantity") < floor)
        rules = [
            (blank["title"], "title is required"),
            (blank["author"], "author is required"),
            (blank["quantity"], "quantity is required"),
            (low, f"quantity must be at least {floor}"),
        ]
    elif kind == "add_genre":
        rules = [(blank["name"], "name is required")]
    else:
        raise ValueError(f"no form rules for {kind!r}")
    reason = F.coalesce(*[F.when(broken, text) for broken, text in rules])
    return requests.select(
        "request_id", F.lit("invalid").alias("outcome"), reason.alias("message")
    ).where(F.col("message").isNotNull())


def all_violations(tables: Tables) -> dict[str, DataFrame]:
    """Every declared rule over one set of tables, by name."""
    found = {}
    for name, schema in TABLES.items():
        df = getattr(tables, name)
        found[f"{name}_primary_key"] = duplicate_keys(df)
        found[f"{name}_not_null"] = missing_values(df, schema)
        if name in TEXT_LIMITS:
            found[f"{name}_length"] = too_long(df, name)
    found["genres_unique_name"] = duplicate_names(tables.genres, "name")
    found["users_unique_username"] = duplicate_names(tables.users, "username")
    found["foreign_keys"] = foreign_key_violations(tables)
    found["borrows_status"] = bad_status(tables.borrows)
    found["borrows_open_pairs"] = repeated_open_loans(tables.borrows)
    return found


# The references between tables: rule's child, its key, the parent.
REFERENCES = (("books", "genre_id", "genres"), ("borrows", "book_id", "books"), ("borrows", "user_id", "users"))
NAMES = {"genres": "name", "users": "username"}


def _facts(tables: Tables, name: str) -> DataFrame:
    """What one scan of a table tells: (rule, k1, k2, word, here, there, broken) per row and rule.

    ``here`` counts the rows with a key, ``there`` whether the key is one of the parent's; row rules fill ``broken``.
    """
    df, schema = getattr(tables, name), TABLES[name]

    def fact(rule: str, k1: Column | None = None, k2: Column | None = None, word: Column | None = None, here: int = 0, there: int = 0, broken: Column | None = None, when: Column | None = None) -> Column:
        nothing = F.lit(None)
        row = F.struct(
            F.lit(rule).alias("rule"),
            (nothing if k1 is None else k1).cast("long").alias("k1"),
            (nothing if k2 is None else k2).cast("long").alias("k2"),
            (nothing if word is None else word).cast("string").alias("word"),
            F.lit(here).cast("long").alias("here"),
            F.lit(there).cast("long").alias("there"),
            (F.lit(0) if broken is None else F.coalesce(broken, F.lit(False)).cast("int")).cast("long").alias("broken"),
        )
        return row if when is None else F.when(when, row)

    found = [
        fact(f"{name}_primary_key", F.col("id"), here=1),
        fact(f"{name}_not_null", broken=_any([F.col(f.name).isNull() for f in schema if not f.nullable])),
    ]
    if name in TEXT_LIMITS:
        found.append(fact(f"{name}_length", broken=_any([F.length(c) > n for c, n in TEXT_LIMITS[name].items()])))
    if name in NAMES:
        found.append(fact(f"{name}_unique_{NAMES[name]}", word=ci(NAMES[name]), here=1))
    if name == "borrows":
        found.append(fact("borrows_status", broken=~F.col("status").isin(*STATUSES)))
        found.append(fact("borrows_open_pairs", F.col("user_id"), F.col("book_id"), here=1, when=is_open("status")))
    for child, key, parent in REFERENCES:
        rule = f"foreign_keys:{child}.{key}"
        if name == child:
            found.append(fact(rule, F.col(key), here=1, when=F.col(key).isNotNull()))
        if name == parent:
            found.append(fact(rule, F.col("id"), there=1, when=F.col("id").isNotNull()))
    return df.select(F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f")).select("f.*")


def violation_counts(tables: Tables) -> DataFrame:
    """(rule, n): how many rows or keys break each declared rule, as ``all_violations`` lists them, in one pass.

    Every table is read once.  A row becomes a fact per rule; facts are added up by rule and key, a key with a third of
    all rows already where they are read, and then by rule.  Rules that nothing breaks are listed with 0.
    """
    facts = functools.reduce(DataFrame.unionByName, [_facts(tables, name) for name in TABLES])
    keys = facts.groupBy("rule", "k1", "k2", "word").agg(*(F.sum(c).alias(c) for c in ("here", "there", "broken")))
    reference = F.col("rule").startswith("foreign_keys:")
    broken = (
        F.when(reference, F.when(F.col("there") == 0, F.col("here")).otherwise(0))
        .when(F.col("here") > 1, 1)
        .otherwise(F.col("broken"))
    )
    counted = keys.groupBy(F.split("rule", ":")[0].alias("rule")).agg(F.sum(broken).alias("n"))
    rules = [f"{name}_{kind}" for name in TABLES for kind in ("primary_key", "not_null", *(("length",) if name in TEXT_LIMITS else ()))]
    rules += [*(f"{name}_unique_{column}" for name, column in NAMES.items()), "foreign_keys", "borrows_status", "borrows_open_pairs"]
    every = F.explode(F.array(*map(F.lit, rules))).alias("rule")
    listed = tables.books.sparkSession.range(1).select(every)
    return listed.join(counted, "rule", "left").select("rule", F.coalesce("n", F.lit(0).cast("long")).alias("n"))

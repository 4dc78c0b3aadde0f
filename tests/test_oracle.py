"""Every registered query against its SQL, value by value."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from workload import oracle

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
}


def by_name(columns, rows):
    """Rows as text tuples in column-name order, sorted; kinds of values stay apart."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER)
    want = duck.sql(contract.oracle_sql()[name])
    want_types = {c: KINDS[str(t)] for c, t in zip(want.columns, want.types)}
    assert dict(got.dtypes) == want_types
    got_rows, want_rows = by_name(got.columns, got.collect()), by_name(want.columns, want.fetchall())
    assert len(got_rows) == len(want_rows)
    assert got_rows == want_rows

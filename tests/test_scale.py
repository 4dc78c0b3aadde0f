"""Plans that must hold on skewed and large inputs, checked on small ones."""

import contextlib
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import accounts, checks
from shelfspark.plans import reports as r
from shelfspark.schema import ADMIN
from shelfspark.operators.requests import with_permission
from shelfspark.sources import database
from shelfspark.sources.files import read_tables, write_tables
from workload import mapping as m

FOLDER = "/root/testdata/sf0.01"


@contextlib.contextmanager
def settings(spark, **values):
    keys = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def large(spark):
    """Nothing is small enough to broadcast, and a few kilobytes count as skew."""
    return settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Written tables in which one member, one book and one genre hold half of all rows."""
    tables = m.star_tables(spark, FOLDER)
    half = F.col("id") % 2 == 0
    borrows = tables.borrows.withColumn("user_id", F.when(half, 7).otherwise(F.col("user_id"))).withColumn(
        "book_id", F.when(half, 3).otherwise(F.col("book_id"))
    )
    folder = str(tmp_path_factory.mktemp("skewed") / "tables")
    write_tables(tables.replace(borrows=borrows.repartition(16)), folder)
    return read_tables(spark, folder)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_busy_member_and_book_are_split(spark, skewed):
    snap = skewed.at(m.AS_OF)
    with large(spark):
        report = r.active_borrows(snap)
        plan = final_plan(report)
        rows = report.count()
    assert len(re.findall(r"isSkewJoin=true|skew=true", plan)) >= 2
    assert rows == snap.open_loans.count()


def test_busy_requester_is_split(spark, skewed):
    asked = skewed.borrows.select(F.col("id").alias("request_id"), "user_id", F.col("due_date").alias("ts"))
    with large(spark):
        plan = final_plan(with_permission(asked, skewed.users, ADMIN))
    assert re.search(r"isSkewJoin=true|skew=true", plan)


def _attempts(skewed):
    """Logins, half of them by one member."""
    names = skewed.users.select(F.col("id").alias("user_id"), "username")
    return skewed.borrows.select(F.col("id").alias("request_id"), "user_id").join(names, "user_id").withColumn(
        "password", F.sha2(F.col("request_id").cast("string"), 512)
    )


@pytest.mark.parametrize(
    "job",
    [
        lambda t: accounts.login_audit(t.users, _attempts(t)),
        lambda t: checks.orphans(t.borrows, "book_id", t.books.where("id <> 3")),
        lambda t: t.borrows.join(t.books.where("id % 5 = 0").select(F.col("id").alias("book_id")), "book_id", "left_anti"),
    ],
    ids=["login_audit", "orphans", "delete_books"],
)
def test_busy_keys_are_split_in_other_jobs(spark, skewed, job):
    with large(spark):
        plan = final_plan(job(skewed))
    # The topmost join is the one the job itself adds.
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "SortMergeJoin(skew=true)" in top


@pytest.mark.parametrize("report", [r.user_stats, r.top_books, r.never_borrowed])
def test_loans_are_reduced_before_they_are_shuffled(spark, skewed, report):
    """The scan of the loans feeds a partial aggregate, not an exchange."""
    with large(spark):
        plan = report(skewed.at(m.AS_OF))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "book_id" in line or "FileScan" in line and "borrowed_at" in line)
    above = [line for line in lines[:scan] if "Exchange" in line or "HashAggregate" in line]
    assert "HashAggregate" in above[-1]


def test_top_reports_shuffle_neither_members_nor_books(spark, skewed):
    with large(spark):
        plan = r.overdue_top(skewed.at(m.AS_OF), trust_keys=True)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert plan.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan


def test_no_report_needs_a_cross_product(spark, skewed):
    snap = skewed.at(m.AS_OF)
    frames = {**r.admin_dashboard(snap), **r.member_page(snap, 7), **checks.all_violations(skewed)}
    with large(spark):
        for name, df in frames.items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_database_tables_are_read_in_ranges(monkeypatch):
    calls = []

    class Frame:
        def first(self):
            return (5, 104)

    class Reader:
        def jdbc(self, url, table, **options):
            calls.append((table, options))
            return Frame()

    class Session:
        read = Reader()

    monkeypatch.setattr(database, "conform", lambda df, schema: df)
    database.read_database(Session(), "jdbc:some:url", 16, {"user": "reader"})
    reads = {table: options for table, options in calls if not table.startswith("(")}
    assert set(reads) == {"books", "borrows", "genres", "users"}
    options = reads["borrows"]
    assert (options["column"], options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("id", 5, 105, 16)
    assert options["properties"]["user"] == "reader"


def test_code_avoids_what_does_not_scale():
    root = pathlib.Path(__file__).parent.parent
    for path in [*root.glob("shelfspark/**/*.py"), *root.glob("workload/*.py")]:
        text = path.read_text()
        for word in ("crossJoin", "localCheckpoint", "toPandas", "current_date", ".rdd"):
            assert word not in text, (path, word)

"""Golden results on the starter library, and edges of single reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.operators.migration import tables_from_legacy
from shelfspark.operators.sweep import sweep
from shelfspark.plans import reports as r
from shelfspark.schema import BORROWS
from shelfspark.sources.seed import starter_legacy, starter_tables

A, B, C = dt.date(2026, 4, 14), dt.date(2026, 4, 18), dt.date(2026, 4, 22)


@pytest.fixture(scope="module")
def tables(spark):
    return starter_tables(spark)


def ids(df):
    return [row.id for row in df.collect()]


@pytest.mark.parametrize(
    "as_of, kpi, days, status, soon, late",
    [
        (A, (6, 5, 7, 0, 8), 6, "active", [], []),
        (B, (6, 5, 7, 0, 8), 2, "active", [2] * 7, []),
        (C, (6, 5, 7, 7, 8), -2, "overdue", [], [2] * 5),
    ],
)
def test_golden_by_date(tables, as_of, kpi, days, status, soon, late):
    snap = tables.at(as_of)
    assert tuple(r.kpi_summary(snap).first()) == kpi
    active = r.active_borrows(snap).collect()
    assert [(row.id, row.days_remaining, row.status) for row in active] == [
        (i, days, status) for i in range(1, 8)
    ]
    assert ids(r.borrow_history(snap)) == [7, 6, 5, 4, 3, 2, 1]
    assert [row.days_rem for row in r.due_soon(snap).collect()] == soon
    assert [row.days_late for row in r.overdue_top(snap).collect()] == late
    mine = r.my_borrows(snap, 5).collect()
    assert [(row.id, row.days_rem) for row in mine] == [(2, days), (3, days), (4, days)]
    assert ids(r.borrowable(snap, 5)) == [1]
    overdue = {C: 1}.get(as_of, 0)
    stats = [
        (row.id, row.total_borrows, row.returned_count, row.active_count, row.overdue_count)
        for row in r.user_stats(snap).collect()
    ]
    assert stats == [
        (5, 3, 0, 3, 3 * overdue),
        (9, 2, 0, 2, 2 * overdue),
        (2, 1, 0, 1, overdue),
        (8, 1, 0, 1, overdue),
    ]


def test_golden_without_dates(tables):
    snap = tables.at(A)
    top = [(row["rank"], row.id, row.borrow_count, row.currently_out) for row in r.top_books(snap).collect()]
    assert top == [(1, 1, 2, 2), (2, 2, 2, 2), (3, 4, 1, 1), (4, 5, 1, 1), (5, 6, 1, 1)]
    assert ids(r.never_borrowed(snap)) == [3]
    sizes = [(row.genre_name, row.book_count) for row in r.genre_stats(snap).collect()]
    assert sizes[:3] == [("Programming", 3), ("Fiction", 1), ("Fantasy", 1)]
    assert [n for _, n in sizes[3:]] == [0] * 5
    assert [(row.id, row.i_have_it) for row in r.browse(snap, 5).collect()] == [
        (3, 0), (5, 0), (2, 1), (4, 1), (1, 0), (6, 1)
    ]
    assert [row.name for row in r.genre_list(snap).collect()] == [
        "Biography", "Fantasy", "Fiction", "Mystery", "Non-Fiction", "Programming", "Science", "Technology"
    ]
    last = {row.id: row.last_borrow_text for row in r.user_stats_display(snap).collect()}
    assert last[2] == "Apr 13, 2026 12:02"
    assert r.catalogue_display(snap).where("id = 6").first().added_text == "Apr 13, 2026"


def test_pages_list_every_report(tables):
    assert len(r.admin_dashboard(tables.at(A))) == 12
    assert set(r.member_page(tables.at(A), 5)) == {"my_borrows", "browse"}


def test_titles_sort_without_regard_to_case(spark, tables):
    books = tables.books.where("id <= 3").withColumn(
        "title", F.element_at(F.create_map(F.lit(1), F.lit("b"), F.lit(2), F.lit("C"), F.lit(3), F.lit("A")), F.col("id").cast("int"))
    )
    assert [row.title for row in r.catalogue(tables.replace(books=books).at(A)).collect()] == ["A", "b", "C"]


def _loans(spark, *rows):
    at = dt.datetime(2026, 4, 1)
    return spark.createDataFrame(
        [(i, 5, 1, at, due, back, status) for i, due, back, status in rows], BORROWS
    )


def test_sweep_boundaries(spark):
    back = dt.datetime(2026, 4, 10)
    loans = _loans(
        spark,
        (1, A, None, "active"),  # due today
        (2, A - dt.timedelta(1), None, "active"),
        (3, A - dt.timedelta(1), back, "returned"),
        (4, A + dt.timedelta(9), None, "overdue"),  # never turns back
        (5, A - dt.timedelta(1), back, "active"),  # returned, but not marked so
    )
    once = sweep(loans, A)
    expected = {1: "active", 2: "overdue", 3: "returned", 4: "overdue", 5: "active"}
    assert {row.id: row.status for row in once.collect()} == expected
    assert sorted(sweep(once, A).collect()) == sorted(once.collect())


def test_snapshot_filters_equal_the_swept_loans(spark, tables):
    rows = [
        (n, A + dt.timedelta(days), back, status)
        for n, (days, back, status) in enumerate(
            (days, back, status)
            for days in (-1, 0, 1)
            for back in (None, dt.datetime(2026, 4, 9))
            for status in ("active", "overdue", "returned")
        )
    ]
    snap = tables.replace(borrows=_loans(spark, *rows)).at(A)
    swept = snap.loans.collect()

    def chosen(*statuses):
        return sorted(row for row in swept if row.status in statuses)

    assert sorted(snap.open_loans.collect()) == chosen("active", "overdue")
    assert sorted(snap.overdue_loans.collect()) == chosen("overdue")
    assert sorted(snap.active_loans.collect()) == chosen("active")


def test_due_soon_limit_is_inclusive(spark, tables):
    loans = _loans(
        spark,
        (1, A + dt.timedelta(3), None, "active"),
        (2, A + dt.timedelta(4), None, "active"),
        (3, A, None, "active"),
    )
    shown = r.due_soon_display(tables.replace(borrows=loans).at(A)).collect()
    assert [(row.id, row.due_text) for row in shown] == [(3, "TODAY"), (1, "in 3d")]


def test_orphans_leave_top_reports_when_keys_are_not_trusted(spark, tables):
    borrows = tables.borrows.withColumn("user_id", F.when(F.col("id") == 7, 99).otherwise(F.col("user_id")))
    snap = tables.replace(borrows=borrows).at(C)
    assert ids(r.borrow_history(snap, trust_keys=False)) == [6, 5, 4, 3, 2, 1]
    assert r.overdue_top(snap, trust_keys=False).count() == 5
    assert r.top_books(snap, trust_keys=False).count() == 5


def test_open_loan_filter_reaches_the_scan(spark, tables, tmp_path):
    path = str(tmp_path / "borrows")
    tables.borrows.write.parquet(path)
    snap = tables.replace(borrows=spark.read.schema(BORROWS).parquet(path)).at(C)
    for df in (snap.open_loans, snap.overdue_loans, snap.active_loans):
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: ")[1].split("]")[0]
        assert "status" in pushed


def test_reused_loans_give_the_same_report(tables):
    snap = tables.at(C)
    with snap.reusing_loans() as kept:
        assert r.user_stats(kept).collect() == r.user_stats(snap).collect()
        assert kept.tables.borrows.is_cached
    assert not kept.tables.borrows.is_cached


def test_legacy_library_becomes_current(spark):
    tables = tables_from_legacy(*starter_legacy(spark))
    assert [tuple(row) for row in tables.genres.collect()] == [(1, "Fiction")]
    assert {row.id: row.genre_id for row in tables.books.collect()} == {
        1: None, 2: None, 3: None, 4: None, 5: None, 6: 1
    }
    assert r.active_borrows(tables.at(A)).count() == 7

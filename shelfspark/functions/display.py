"""The text and bands that reports show next to the plain values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import as_column
from shelfspark.schema import LOAN_DAYS, SOON_BAND_DAYS


# Month names as shown.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def day_text(ts: Column | str) -> Column:
    """'Apr 13, 2026'.  From the parts, since formatting a zone-free time would
    first place it in the session's zone."""
    month = F.element_at(F.array(*[F.lit(name) for name in MONTHS]), F.month(ts))
    year = F.lpad(F.year(ts).cast("string"), 4, "0")
    return F.concat(month, F.lit(" "), _two(F.dayofmonth(ts)), F.lit(", "), year)


def minute_text(ts: Column | str) -> Column:
    """'Apr 13, 2026 12:02'."""
    return F.concat(day_text(ts), F.lit(" "), _two(F.hour(ts)), F.lit(":"), _two(F.minute(ts)))


def status_text(status: Column | str) -> Column:
    return F.initcap(status)


def _days(n: Column, suffix: str) -> Column:
    return F.concat(F.abs(n).cast("string"), F.lit(suffix))


def days_text(days_left: Column | str) -> Column:
    n = as_column(days_left)
    return F.when(n < 0, _days(n, "d late")).otherwise(_days(n, "d left"))


def due_band(days_left: Column | str) -> Column:
    n = as_column(days_left)
    return F.when(n < 0, "late").when(n <= SOON_BAND_DAYS, "soon").otherwise("ok")


def time_bar(days_left: Column | str) -> Column:
    """Share of the loan period that is left, as a percentage from 0 to 100."""
    share = as_column(days_left) / F.lit(LOAN_DAYS) * 100
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))


def due_soon_text(days_left: Column | str) -> Column:
    n = as_column(days_left)
    return F.when(n == 0, "TODAY").otherwise(F.concat(F.lit("in "), n.cast("string"), F.lit("d")))


def member_due_text(status: Column | str, days_left: Column | str) -> Column:
    """What a member sees under a loan; the status decides before the days do."""
    n = as_column(days_left)
    return (
        F.when(as_column(status) == "overdue", _days(n, "d overdue"))
        .when(n == 0, "Due today!")
        .when(n <= SOON_BAND_DAYS, F.concat(F.lit("Due in "), n.cast("string"), F.lit("d")))
    )


def stock_badge(quantity: Column | str) -> Column:
    return F.when(as_column(quantity) > 0, "in").otherwise("out")


def stock_text(quantity: Column | str) -> Column:
    q = as_column(quantity)
    return F.when(q > 0, F.concat(q.cast("string"), F.lit(" left"))).otherwise("Out of stock")


def action_text(has_it: Column, quantity: Column | str) -> Column:
    return (
        F.when(has_it, "Borrowed")
        .when(as_column(quantity) > 0, "Borrow")
        .otherwise("Unavailable")
    )


def shown(name: Column | str) -> Column:
    """A name as pages test it: missing, empty and '0' all count as none."""
    c = as_column(name)
    return F.when(~c.isin("", "0"), c)


def genre_cell(name: Column | str) -> Column:
    return F.coalesce(shown(name), F.lit("—"))


def legacy_genre_cell(genre: Column | str) -> Column:
    """Free-text genre in a table cell: only a missing one becomes a dash."""
    return F.coalesce(as_column(genre), F.lit("—"))

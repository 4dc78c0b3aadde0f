"""Predicates and date arithmetic on loans.  The clock is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.schema import DUE_SOON_DAYS, LOAN_DAYS, OPEN_STATUSES


def is_open(status: Column | str) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return status.isin(*OPEN_STATUSES)


def is_past_due(loans: DataFrame, as_of: dt.date) -> Column:
    """Due strictly before ``as_of`` and still out; due today is not late."""
    return (loans["due_date"] < F.lit(as_of)) & loans["returned_at"].isNull()


def days_until(date: Column | str, as_of: dt.date) -> Column:
    """Signed days from ``as_of`` to ``date``; negative when it has passed."""
    return F.datediff(date, F.lit(as_of))


def days_since(date: Column | str, as_of: dt.date) -> Column:
    return F.datediff(F.lit(as_of), date)


def due_soon_limit(as_of: dt.date) -> Column:
    return F.date_add(F.lit(as_of), DUE_SOON_DAYS)


def due_date(ts: Column | str) -> Column:
    """The date a loan taken at ``ts`` is due."""
    return F.date_add(F.to_date(ts), LOAN_DAYS)

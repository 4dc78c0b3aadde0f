"""The four tables, and the view of them at one date."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from shelfspark.functions.loans import is_open, is_past_due
from shelfspark.operators.sweep import sweep
from shelfspark.schema import TABLES, conform


@dataclasses.dataclass(frozen=True)
class Tables:
    books: DataFrame
    borrows: DataFrame
    genres: DataFrame
    users: DataFrame
    # (tbl, next_id): keys go on from there, also where rows with higher keys are gone.
    counters: DataFrame | None = None

    def conformed(self) -> Tables:
        return self.replace(**{name: conform(getattr(self, name), TABLES[name]) for name in TABLES})

    def replace(self, **changed: DataFrame) -> Tables:
        return dataclasses.replace(self, **changed)

    def at(self, as_of: dt.date) -> Snapshot:
        return Snapshot(self, as_of)


@dataclasses.dataclass(frozen=True)
class Snapshot:
    """Tables with the overdue sweep applied for ``as_of``.

    Sweeping rewrites ``status`` with an expression that no file format can
    filter on.  A sweep never opens or closes a loan, so each property below
    filters on the stored columns first, where the scan can skip data, and
    sweeps what is left.
    """

    tables: Tables
    as_of: dt.date

    @property
    def books(self) -> DataFrame:
        return self.tables.books

    @property
    def genres(self) -> DataFrame:
        return self.tables.genres

    @property
    def users(self) -> DataFrame:
        return self.tables.users

    @property
    def loans(self) -> DataFrame:
        return sweep(self.tables.borrows, self.as_of)

    @property
    def open_loans(self) -> DataFrame:
        return sweep(self.tables.borrows.where(is_open("status")), self.as_of)

    @property
    def overdue_loans(self) -> DataFrame:
        stored = self.tables.borrows
        late = stored["status"] == "overdue"
        turning = (stored["status"] == "active") & is_past_due(stored, self.as_of)
        return sweep(stored.where(late | turning), self.as_of)

    @property
    def active_loans(self) -> DataFrame:
        stored = self.tables.borrows
        return stored.where((stored["status"] == "active") & ~is_past_due(stored, self.as_of))

    @contextmanager
    def reusing_loans(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[Snapshot]:
        """Keep the loans for several reports in one job, then let go of them.

        Worth it when the loans are costly to derive; over plain Parquet the
        pruned scans of each report are usually cheaper than a cached copy.
        """
        kept = self.tables.borrows.persist(level)
        try:
            yield Snapshot(self.tables.replace(borrows=kept), self.as_of)
        finally:
            kept.unpersist()

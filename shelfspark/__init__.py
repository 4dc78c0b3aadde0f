"""Lending-ledger analytics as Spark DataFrame jobs."""

from shelfspark.session import build_session
from shelfspark.tables import Snapshot, Tables

__all__ = ["Snapshot", "Tables", "build_session"]

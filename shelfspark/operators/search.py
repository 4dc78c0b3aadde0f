"""Substring search over the text a report row shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import display as d
from shelfspark.functions.text import contains_ci, or_dash

# Fixed value: what lies between two cells of a row, a line break and
# indentation, so that no typed query matches across cells.
CELL_GAP = "\n" + " " * 16


def row_text(cells: Sequence[Column]) -> Column:
    """The row as one text; a NULL cell is not shown at all."""
    gap = F.lit(CELL_GAP)
    return F.concat(gap, F.concat_ws(CELL_GAP, *cells), gap)


def search(df: DataFrame, cells: Sequence[Column], query: str) -> DataFrame:
    """Rows whose shown text contains ``query``; no wildcards, case ignored."""
    return df.where(contains_ci(row_text(cells), query))


def catalogue_cells() -> list[Column]:
    return [
        F.col("id").cast("string"),
        F.col("title"),
        F.col("author"),
        d.genre_cell("genre_name"),
        F.col("quantity").cast("string"),
        d.day_text("created_at"),
    ]


def search_catalogue(catalogue: DataFrame, query: str) -> DataFrame:
    return search(catalogue, catalogue_cells(), query)


def search_history(history: DataFrame, query: str) -> DataFrame:
    """Over the history report, so over the latest loans it lists."""
    cells = [
        F.col("username"),
        F.col("title"),
        d.genre_cell("genre_name"),
        F.col("borrowed_at").cast("string"),
        F.col("due_date").cast("string"),
        or_dash("returned_at"),
        d.status_text("status"),
    ]
    return search(history, cells, query)


def search_browse(browse: DataFrame, query: str) -> DataFrame:
    cells = [
        d.shown("genre_name"),
        F.col("title"),
        F.col("author"),
        d.stock_text("quantity"),
        d.action_text(F.col("i_have_it") > 0, "quantity"),
    ]
    return search(browse, cells, query)

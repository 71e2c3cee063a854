"""Raw-grain rows of a page as CSV or preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellkpi.functions.cells import CELL
from cellkpi.sources.extracts import CSV_DIALECT

HELPER_COLUMNS = ["site", "SiteKey"]
EXPORT_ORDER = ["DATE_ID", CELL]


def export_rows(rows: DataFrame) -> DataFrame:
    """Page rows as they are shown: source columns and cell dimensions, without our own keys."""
    return rows.drop(*HELPER_COLUMNS)


def write_csv(rows: DataFrame, path: str) -> None:
    """The export as CSV files with headers, ordered by time and cell across the files.

    Quotes inside values are doubled, as other CSV readers expect.
    """
    ordered = export_rows(rows).orderBy(*EXPORT_ORDER)
    ordered.write.mode("overwrite").options(**CSV_DIALECT).csv(path)


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows by time and cell; the other columns settle ties."""
    shown = export_rows(rows)
    others = [c for c in shown.columns if c not in EXPORT_ORDER]
    return shown.orderBy(*EXPORT_ORDER, *[F.col(c) for c in others]).limit(n)

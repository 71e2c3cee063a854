"""The rows behind a page: filtered, in page units, with the cell's dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellkpi.operators.filters import SITE_MODES, Day, dates_between, in_bands
from cellkpi.operators.measures import scale_measures, with_hour_timestamp
from cellkpi.sources.extracts import with_cell_dimensions

PAGE_PERIODS = {"daily": ["Daily", "Weekly", "Monthly"], "hourly": ["Hourly"]}


def check_period(grain: str, period: str) -> str:
    if period not in PAGE_PERIODS.get(grain, []):
        raise ValueError(f"no {period!r} page of {grain} facts, choose from {PAGE_PERIODS}")
    return period


def page_rows(
    facts: DataFrame,
    grain: str,
    *,
    site: str | None = None,
    site_mode: str = "contains",
    start: Day | None = None,
    end: Day | None = None,
    bands: list[str] | None = None,
) -> DataFrame:
    """Facts of one site or of all, at raw grain.

    ``site`` labels the page a row belongs to: with ``contains`` it is the text asked for, whatever
    cells that matched, otherwise the cell's own site in lower case. Dates are compared before hours
    are added, so the last day keeps all its hours.
    """
    df = dates_between(facts, start, end)
    if site is not None:
        if site_mode not in SITE_MODES:
            raise ValueError(f"unknown site mode {site_mode!r}, expected one of {list(SITE_MODES)}")
        df = SITE_MODES[site_mode](df, site)
    return finish_rows(in_bands(with_cell_dimensions(df), bands), grain, site, site_mode)


def finish_rows(df: DataFrame, grain: str, site: str | None, site_mode: str) -> DataFrame:
    """Chosen facts in page units, with dimensions and the label of their page."""
    df = scale_measures(with_cell_dimensions(df), grain)
    if grain == "hourly":
        df = with_hour_timestamp(df)
    return page_label(df, site, site_mode)


def page_label(df: DataFrame, site: str | None, site_mode: str) -> DataFrame:
    """``df`` with ``site``: the text asked for with ``contains``, otherwise the cell's own site."""
    whole_page = site is not None and site_mode == "contains"
    return df.withColumn("site", F.lit(site.lower()) if whole_page else F.col("SiteKey"))


@contextmanager
def cached(rows: DataFrame) -> Iterator[DataFrame]:
    """The rows kept for several reports over the same page, and released afterwards."""
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()

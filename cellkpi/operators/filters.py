"""Row filters. Each takes and returns a frame, for use with ``DataFrame.transform``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellkpi.functions import cells

# The first day shown by default, and the days shown by default on the hourly page.
FIRST_DAY = dt.date(2023, 7, 1)
HOURLY_DAYS = 3

Day = dt.date | str | Column


def check_site(site: str) -> str:
    if len(site) != cells.SITE_LENGTH:
        raise ValueError(f"a site has {cells.SITE_LENGTH} characters, got {site!r}")
    return site


def like_text(cell: Column, text: str) -> Column:
    """Whether a cell name holds the text, in any case; ``_`` and ``%`` in it match as in LIKE."""
    return F.lower(cell).like(f"%{text.lower()}%")


def site_contains(df: DataFrame, site: str) -> DataFrame:
    """Cells whose name holds the text (``like_text``). ``sources.cell_index`` finds them by an index."""
    return df.where(like_text(F.col(cells.CELL), check_site(site)))


def site_is(df: DataFrame, site: str) -> DataFrame:
    """Cells of one site, in any case. On a stored ``SiteKey`` this reaches the file scan."""
    key = F.col("SiteKey") if "SiteKey" in df.columns else cells.site_key()
    return df.where(key == check_site(site).lower())


SITE_MODES = {"contains": site_contains, "exact": site_is}


def _date(day: Day) -> Column:
    return day if isinstance(day, Column) else F.lit(str(day)).cast("date")


def dates_between(df: DataFrame, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; a missing end is open."""
    if start is not None:
        df = df.where(F.col("DATE_ID") >= _date(start))
    if end is not None:
        df = df.where(F.col("DATE_ID") <= _date(end))
    return df


def default_dates(grain: str) -> tuple[Column, Column]:
    """The range that a page shows before the user chooses one."""
    today = F.current_date()
    if grain == "daily":
        return F.lit(FIRST_DAY), today
    if grain == "hourly":
        return F.date_sub(today, HOURLY_DAYS), today
    raise ValueError(f"unknown grain {grain!r}, expected daily or hourly")


def in_bands(df: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """Rows of the chosen bands. The default is all real bands; an empty list leaves no rows."""
    chosen = cells.BANDS if bands is None else bands
    unknown = sorted(set(chosen) - set(cells.BANDS))
    if unknown:
        raise ValueError(f"unknown bands {unknown}, expected some of {cells.BANDS}")
    band = F.col("Band") if "Band" in df.columns else cells.band()
    return df.where(band.isin(chosen))


def in_sector(df: DataFrame, *sectors: str) -> DataFrame:
    """Rows of the given sectors, of any of the three if none is given."""
    sector = F.col("Sector") if "Sector" in df.columns else cells.sector()
    return df.where(sector.isin(list(sectors or cells.SECTORS)))

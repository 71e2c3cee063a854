"""Reports from sums and counts kept per day and cell.

Means over weeks and months are means of rows, so days can't be averaged; their sums and counts can be
added. A table of partials holds both for every counter that a chart names, per day and cell, in page
units and, with ``decimals``, in exact whole units, so that a report merged from days equals the report of
the facts to the last bit. It is laid out like the facts: by day, sorted by site and cell.

``load_facts`` keeps both tables in step: the partials of the days that it touches are computed again
from the facts and replace those days alone. Both writes can be repeated, so a load that dies between
them is completed by loading again, or by ``refresh_partials``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellkpi.functions.cells import CELL
from cellkpi.functions.values import sum_units
from cellkpi.operators.filters import SITE_MODES, Day, dates_between, in_bands
from cellkpi.operators.measures import units_of
from cellkpi.plans.catalog import CHARTS, Chart
from cellkpi.plans.page import page_label, page_rows
from cellkpi.plans.report import COUNT, SUM, Source, report_of
from cellkpi.sources.extracts import DIMENSIONS
from cellkpi.sources.tables import PARTITION, read_facts, write_facts

GRAIN = "daily"


def day_partials(
    facts: DataFrame, decimals: int | None = None, charts: list[Chart] = CHARTS
) -> DataFrame:
    """One row per day and cell of daily facts: a sum and a count of every charted counter."""
    rows = page_rows(facts, GRAIN)
    parts = []
    for kpi in dict.fromkeys(c.kpi for c in charts):
        value = F.col(kpi) if decimals is None else units_of(kpi, decimals)
        total = F.sum(value) if decimals is None else sum_units(value, decimals)
        parts += [total.alias(SUM.format(kpi)), F.count(value).alias(COUNT.format(kpi))]
    # A stored sector may differ from the cell's, so the dimensions are keys and not derived again.
    return rows.groupBy(PARTITION, CELL, *DIMENSIONS).agg(*parts)


def refresh_partials(
    spark: SparkSession,
    facts_path: str,
    partials_path: str,
    days: DataFrame | None = None,
    decimals: int | None = None,
) -> None:
    """Compute partials again from the facts: of the days in ``days``, or of all."""
    facts = read_facts(spark, facts_path)
    if days is None:
        write_facts(day_partials(facts, decimals), partials_path, "replace")
        return
    # At most as many rows as the load has days; they prune the facts' folders at run time.
    touched = F.broadcast(days.select(PARTITION).where(F.col(PARTITION).isNotNull()).distinct())
    some = facts.join(touched, PARTITION, "left_semi")
    write_facts(day_partials(some, decimals), partials_path, "reload")


def load_facts(
    facts: DataFrame,
    facts_path: str,
    partials_path: str,
    mode: str = "reload",
    *,
    decimals: int | None = None,
) -> None:
    """Load daily facts as ``write_facts`` does and bring the partials of their days up to date."""
    write_facts(facts, facts_path, mode)
    days = None if mode == "replace" else facts
    refresh_partials(facts.sparkSession, facts_path, partials_path, days, decimals)


def page_partials(
    partials: DataFrame,
    *,
    site: str | None = None,
    site_mode: str = "contains",
    start: Day | None = None,
    end: Day | None = None,
    bands: list[str] | None = None,
) -> DataFrame:
    """Partials of one site or of all; the same scope as ``page_rows`` has for facts."""
    df = dates_between(partials, start, end)
    if site is not None:
        if site_mode not in SITE_MODES:
            raise ValueError(f"unknown site mode {site_mode!r}, expected one of {list(SITE_MODES)}")
        df = SITE_MODES[site_mode](df, site)
    return page_label(in_bands(df, bands), site, site_mode)


def report_from_partials(
    partials: DataFrame,
    period: str,
    *,
    charts: list[Chart] = CHARTS,
    decimals: int | None = None,
    **scope,
) -> DataFrame:
    """The report by day, week or month, equal to that of the facts; reads partials only."""
    return report_of(
        page_partials(partials, **scope), GRAIN, period, charts, Source(decimals, partials=True)
    )

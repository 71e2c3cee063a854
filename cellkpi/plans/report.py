"""All charts of all pages in one job.

Cells are the finest series. One aggregation by bucket and cell covers every chart drawn per cell,
over the counters those charts name. One aggregation by bucket, sector and band covers the charts
per band and the site totals, which are sums of its rows, and reads only their counter. Values turn
from one column per KPI into one row per chart after that, when no shuffle follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellkpi.functions.cells import CELL, SECTORS
from cellkpi.functions.values import (
    AGGREGATES,
    from_units,
    page_title,
    sum_units,
)
from cellkpi.operators.axes import ALL_SECTORS, first_bucket, first_times, stack
from cellkpi.operators.measures import aggregate_of, units_of
from cellkpi.operators.rollups import with_bucket
from cellkpi.plans.catalog import (
    BAND_SERIES,
    CELL_SERIES,
    CHARTS,
    TOTAL_SERIES,
    Chart,
    chart_frame,
)
from cellkpi.plans.page import check_period, page_rows

SERIES_KEYS = ["site", "bucket", "series_key", "sector", "series"]


@dataclass(frozen=True)
class Source:
    """What the rows of a report hold: counters, or ``partials``, their sums and counts."""

    decimals: int | None = None
    partials: bool = False



SUM, COUNT = "sum_{}", "count_{}"  # columns of a counter's parts


def _aggregated(rows: DataFrame, keys: list[str], charts: list[Chart], source: Source) -> DataFrame:
    """The charts' values by ``keys``, one column per aggregated KPI."""
    wanted = list(dict.fromkeys((c.agg, c.kpi) for c in charts))
    decimals = source.decimals
    if source.partials:
        values = [_of_parts(agg, kpi, decimals) for agg, kpi in wanted]
    else:
        values = [aggregate_of(agg, kpi, decimals) for agg, kpi in wanted]
    named = [v.alias(f"{agg}_{kpi}") for v, (agg, kpi) in zip(values, wanted, strict=True)]
    return rows.groupBy(*keys).agg(*named)


def _of_parts(agg: str, kpi: str, decimals: int | None) -> Column:
    """A sum or mean from columns of sums (in units, with ``decimals``) and counts."""
    total = F.sum(SUM.format(kpi))
    if decimals is not None:
        total = from_units(sum_units(F.col(SUM.format(kpi)), single=False), decimals)
    if agg == "sum":
        return total
    return F.try_divide(total, F.sum(COUNT.format(kpi)).cast("double"))


def _parts(rows: DataFrame, keys: list[str], kpis: list[str], source: Source) -> DataFrame:
    """Sums and counts by ``keys`` that still add up: sums stay in units, counts apart."""
    decimals = source.decimals
    parts = []
    for kpi in kpis:
        if source.partials:
            value, count = F.col(SUM.format(kpi)), F.sum(COUNT.format(kpi))
        else:
            value = F.col(kpi) if decimals is None else units_of(kpi, decimals)
            count = F.count(value)
        exact = decimals is not None
        total = sum_units(value, decimals, single=not source.partials) if exact else F.sum(value)
        parts += [total.alias(SUM.format(kpi)), count.alias(COUNT.format(kpi))]
    return rows.groupBy(*keys).agg(*parts)


def _cell_values(rows: DataFrame, charts: list[Chart], source: Source) -> DataFrame:
    """One row per site, bucket and cell of a charted sector, one column per aggregated KPI."""
    charted = rows.where(F.col("Sector").isin(sorted({c.sector for c in charts})))
    per_cell = _aggregated(charted, ["site", "bucket", "Sector", CELL], charts, source)
    return per_cell.withColumnsRenamed({"Sector": "sector", CELL: "series"}).withColumn(
        "series_key", F.lit(CELL_SERIES)
    )


def _band_values(rows: DataFrame, charts: list[Chart], source: Source) -> DataFrame:
    """One row per site, bucket and band of a sector, band of the site, and site."""
    wanted = dict.fromkeys((c.agg, c.kpi) for c in charts)
    kinds = {(c.series_key, c.sector == ALL_SECTORS) for c in charts}
    sets = {
        (BAND_SERIES, False): ["site", "bucket", "Sector", "Band"],
        (BAND_SERIES, True): ["site", "bucket", "Band"],
        (TOTAL_SERIES, True): ["site", "bucket"],
    }
    unknown = kinds - set(sets)
    if unknown:
        raise ValueError(f"charts with unsupported series: {sorted(unknown)}")

    kpis = list(dict.fromkeys(kpi for _, kpi in wanted))
    finest = _parts(rows, ["site", "bucket", "Sector", "Band"], kpis, source)
    finished = [_of_parts(a, k, source.decimals).alias(f"{a}_{k}") for a, k in wanted]
    return (
        finest.groupingSets(
            [sets[k] for k in sets if k in kinds], "site", "bucket", "Sector", "Band"
        )
        .agg(
            (F.grouping("Sector") == 1).alias("over_sectors"),
            (F.grouping("Band") == 1).alias("over_bands"),
            *finished,
        )
        # A stored sector may be missing or undefined; only the roll-up itself makes "All".
        .where(F.col("over_sectors") | F.col("Sector").isin(SECTORS))
        .select(
            "site",
            "bucket",
            F.when(F.col("over_sectors"), ALL_SECTORS).otherwise(F.col("Sector")).alias("sector"),
            F.when(F.col("over_bands"), TOTAL_SERIES).otherwise(F.col("Band")).alias("series"),
            F.when(F.col("over_bands"), TOTAL_SERIES).otherwise(BAND_SERIES).alias("series_key"),
            *[f"{a}_{k}" for a, k in wanted],
        )
    )


def _chart_rows(
    values: DataFrame,
    charts: list[Chart],
    decimals: int | None,
    stacked: bool,
    parts: int | None = None,
) -> DataFrame:
    """One row per chart, bucket and series, from one column per aggregated KPI."""
    measures = list(dict.fromkeys(f"{c.agg}_{c.kpi}" for c in charts))
    long = values.unpivot(SERIES_KEYS, measures, "measure", "value")
    if stacked:
        # Before the catalogue's columns join, so that the window shuffles narrow rows.
        long = stack(long, ["site", "bucket", "series_key", "sector", "measure"], decimals, parts=parts)
    catalog = chart_frame(values.sparkSession, charts)
    catalog = catalog.withColumn("measure", F.concat_ws("_", "agg", "kpi")).drop("agg")
    # The catalogue is a list in the program: one row per chart, whatever the size of the facts.
    return long.join(F.broadcast(catalog), ["measure", "series_key", "sector"])


def _report(
    rows: DataFrame,
    period: str,
    charts: list[Chart],
    source: Source,
    stacked: bool = False,
    stack_parts: int | None = None,
) -> DataFrame:
    unknown = {c.agg for c in charts} - set(AGGREGATES)
    if unknown or not charts:
        raise ValueError(f"nothing to report, or unknown aggregations: {sorted(unknown)}")
    timed = with_bucket(rows, period)
    by_cell = [c for c in charts if c.series_key == CELL_SERIES]
    by_band = [c for c in charts if c.series_key != CELL_SERIES]
    parts = []
    for group, values_of in ((by_cell, _cell_values), (by_band, _band_values)):
        if group:
            values = values_of(timed, group, source)
            parts.append(_chart_rows(values, group, source.decimals, stacked, stack_parts))
    merged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    value = F.col("value")
    below = F.coalesce(value < F.col("y_min"), F.lit(False))
    above = F.coalesce(value > F.col("y_max"), F.lit(False))
    return merged.select(
        page_title(F.lit(period), F.col("site")).alias("page"),
        "site",
        "item_id",
        "title",
        "kpi",
        "shape",
        "sector",
        "series",
        "bucket",
        "value",
        "y_min",
        "y_max",
        (below | above).alias("out_of_range"),
        *(["stack_top"] if stacked else []),
    )


def report(
    rows: DataFrame,
    period: str,
    *,
    charts: list[Chart] = CHARTS,
    decimals: int | None = None,
) -> DataFrame:
    """Every series of every chart for the page rows, one row per chart, bucket and series.

    ``out_of_range`` marks values outside the chart's fixed value range. Where the time axis of a
    chart starts is in ``chart_axes``, once per chart. Nothing is joined by site or shuffled by
    it alone.
    """
    return _report(rows, period, charts, Source(decimals))


def report_of(
    rows: DataFrame, grain: str, period: str, charts: list[Chart], source: Source
) -> DataFrame:
    """The report of rows that hold what ``source`` says, for a period that the grain has."""
    check_period(grain, period)
    return _report(rows, period, charts, source)


def page_report(
    facts: DataFrame,
    grain: str,
    period: str,
    *,
    charts: list[Chart] = CHARTS,
    decimals: int | None = None,
    **scope,
) -> DataFrame:
    """The report straight from a fact table; ``scope`` is that of ``page_rows``."""
    check_period(grain, period)
    return report(page_rows(facts, grain, **scope), period, charts=charts, decimals=decimals)


def chart_axes(rows: DataFrame, period: str, *, charts: list[Chart] = CHARTS) -> DataFrame:
    """One row per page and chart that has data: its first bucket and value range."""
    timed = with_bucket(rows, period)
    starts = first_times(timed)
    catalog = chart_frame(rows.sparkSession, charts)
    per_sector = F.explode(F.array(*[F.lit(s) for s in [ALL_SECTORS, *SECTORS]])).alias("sector")
    axes = starts.select("*", per_sector).withColumn(
        "first_bucket", first_bucket(period, F.col("sector"))
    )
    return (
        axes.where(F.col("first_bucket").isNotNull())
        .join(F.broadcast(catalog), "sector")
        .select("site", "item_id", "title", "sector", "first_bucket", "y_min", "y_max")
    )


def stacked_areas(
    rows: DataFrame,
    period: str,
    *,
    charts: list[Chart] = CHARTS,
    decimals: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """The series of the area charts with the height at which each one ends in the stack.

    ``parts`` spreads buckets of very many series over that many tasks, as a page that matches all
    cells has them; the rows go through the shared scratch folder then.
    """
    areas = [c for c in charts if c.shape == "area"]
    return _report(rows, period, areas, Source(decimals), stacked=True, stack_parts=parts)


def out_of_range(
    rows: DataFrame,
    period: str,
    *,
    charts: list[Chart] = CHARTS,
    decimals: int | None = None,
) -> DataFrame:
    """The values outside the value range of their chart; charts without one are not computed."""
    ranged = [c for c in charts if c.y_min is not None or c.y_max is not None]
    return report(rows, period, charts=ranged, decimals=decimals).where("out_of_range")

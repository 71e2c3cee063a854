"""Calendar-bucketed sums and means of page rows, per site.

The input is the output of ``plans.page.page_rows``. Each function is one grouped aggregation:
Spark aggregates partially before the shuffle, so a busy site or cell sends one row per task and
group. Rows without a time have no bucket and are left out here; ``untimed_rows`` counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellkpi.functions.buckets import bucket
from cellkpi.functions.cells import CELL
from cellkpi.operators.filters import in_sector
from cellkpi.operators.measures import aggregate_of

TRAFFIC = "Total_Traffic_Volume"


def with_bucket(rows: DataFrame, period: str) -> DataFrame:
    return rows.withColumn("bucket", bucket(period)).where(F.col("bucket").isNotNull())


def untimed_rows(rows: DataFrame) -> DataFrame:
    """Rows per site that no bucket holds, for lack of a date or an hour."""
    return rows.where(F.col("DATE_ID").isNull()).groupBy("site").agg(F.count("*").alias("rows"))


def series(
    rows: DataFrame,
    period: str,
    by: list[str],
    kpis: dict[str, str],
    decimals: int | None = None,
) -> DataFrame:
    """One value per site, bucket and ``by`` columns for each KPI, given as {KPI: aggregation}."""
    values = [aggregate_of(how, kpi, decimals).alias(kpi) for kpi, how in kpis.items()]
    return with_bucket(rows, period).groupBy("site", "bucket", *by).agg(*values)


def traffic_by_band(rows: DataFrame, period: str, decimals: int | None = None) -> DataFrame:
    return series(rows, period, ["Band"], {TRAFFIC: "sum"}, decimals)


def traffic_total(rows: DataFrame, period: str, decimals: int | None = None) -> DataFrame:
    return series(rows, period, [], {TRAFFIC: "sum"}, decimals)


def traffic_by_sector_band(rows: DataFrame, period: str, decimals: int | None = None) -> DataFrame:
    return series(in_sector(rows), period, ["Sector", "Band"], {TRAFFIC: "sum"}, decimals)


def traffic_by_sector_cell(rows: DataFrame, period: str, decimals: int | None = None) -> DataFrame:
    return series(in_sector(rows), period, ["Sector", CELL], {TRAFFIC: "sum"}, decimals)


def means_by_sector_cell(
    rows: DataFrame, period: str, kpis: list[str], decimals: int | None = None
) -> DataFrame:
    return series(in_sector(rows), period, ["Sector", CELL], dict.fromkeys(kpis, "mean"), decimals)

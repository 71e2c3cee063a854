"""Unit changes and the time column of the two grains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellkpi.functions.buckets import hour_timestamp
from cellkpi.functions.values import aggregate, checked_units

# The volumes that daily pages divide, by how much, and the success rate that is
# shown as a failure rate.
VOLUMES = ["Downlink_Traffic_Volume", "Uplink_Traffic_Volume", "Total_Traffic_Volume"]
VOLUME_SCALE = {"daily": 1000, "hourly": 1}
COMPLEMENTED = "LTE_CSFB_SR"
# What a counter was taken from, where that is larger than the counter: its rounding is of that size.
MAGNITUDES = {COMPLEMENTED: 100.0}


def scale_measures(df: DataFrame, grain: str) -> DataFrame:
    """Show the failure rate and, for daily facts, volumes in thousands. Hourly ones stay as is."""
    if grain not in VOLUME_SCALE:
        raise ValueError(f"unknown grain {grain!r}, expected one of {list(VOLUME_SCALE)}")
    scale = VOLUME_SCALE[grain]
    changed = {}
    if COMPLEMENTED in df.columns:
        changed[COMPLEMENTED] = F.lit(100) - F.col(COMPLEMENTED)
    if scale != 1:
        changed.update({c: F.col(c) / scale for c in VOLUMES if c in df.columns})
    return df.withColumns(changed) if changed else df


def with_hour_timestamp(df: DataFrame) -> DataFrame:
    """``DATE_ID`` and ``HOUR_ID`` merged into a timestamp called ``DATE_ID``."""
    moment = hour_timestamp(F.col("DATE_ID"), F.col("HOUR_ID"))
    return df.withColumn("DATE_ID", moment).drop("HOUR_ID")


def units_of(kpi: str, decimals: int) -> Column:
    """A counter as checked units."""
    return checked_units(F.col(kpi), decimals, MAGNITUDES.get(kpi, 0.0))


def aggregate_of(agg: str, kpi: str, decimals: int | None) -> Column:
    """The sum or mean of a counter."""
    return aggregate(agg, F.col(kpi), decimals, MAGNITUDES.get(kpi, 0.0))

"""Calendar buckets: left-closed, labelled by their start, weeks from Monday.

Buckets without rows do not appear, and a label may precede the first day asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_start(date: Column) -> Column:
    return date.cast("date")


def week_start(date: Column) -> Column:
    return F.trunc(date, "week")


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def hour_timestamp(date: Column, hour: Column) -> Column:
    """Midnight of ``date`` plus ``hour`` hours, without a time zone; hours from 24 on roll over."""
    return F.timestamp_add("HOUR", hour.cast("int"), date.cast("date").cast("timestamp_ntz"))


def hour_start(timestamp: Column) -> Column:
    """Start of the hour of a zone-free timestamp, whatever the session time zone."""
    return hour_timestamp(timestamp, F.hour(timestamp))


PERIODS: dict[str, Callable[[Column], Column]] = {
    "Daily": day_start,
    "Weekly": week_start,
    "Monthly": month_start,
    "Hourly": hour_start,
}


def bucket(period: str, time: Column | None = None) -> Column:
    """The bucket start of ``time`` (``DATE_ID`` unless given) for a period name."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}, expected one of {list(PERIODS)}")
    return PERIODS[period](F.col("DATE_ID") if time is None else time)

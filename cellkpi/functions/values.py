"""Text to numbers and dates, and the aggregates that a report may name.

Sums of doubles depend on the order in which tasks deliver them. Where the counters are known to
carry at most ``decimals`` decimal places, the aggregates here can add whole units of that size
instead: exact, the same after any retry or repartitioning, and about as cheap as a double sum. A
value with more places, a value too large for exact units and a sum too large for a long all raise
an error, whether the session is in ANSI mode or not. Only what binary rounding does to a decimal
number passes: two units in the last place of the double, or of the ``magnitude`` of the numbers that
it was computed from. Infinite values and NaN have no units; exact sums and means skip them like
missing values. Without ``decimals`` they are Spark's own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"


def to_number(text: Column) -> Column:
    """A number where the text is one, NULL otherwise (also for ``NaN`` and for ``1.0d``)."""
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def to_date(
    text: Column, fmt: str | Sequence[str] | None = None, *, strict: bool = True
) -> Column:
    """A date; text that is not one raises an error, or becomes NULL if not ``strict``.

    Several formats are tried in their order; the first that fits counts.
    """
    formats = [fmt] if isinstance(fmt, str) else list(fmt or [])
    if formats:
        parsed = F.coalesce(*(F.try_to_date(text, f) for f in formats))
    else:
        parsed = text.try_cast("date")
    if not strict:
        return parsed
    complaint = F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date")
    return F.when(parsed.isNull() & text.isNotNull(), complaint).otherwise(parsed)


# Whole doubles up to here are exact. Binary rounding of a value, and of one step of arithmetic on it.
LARGEST_UNITS = float(1 << 53)
ROUNDING = 2.0**-51
NO_UNITS = 1 << 53  # stands for a value that is no whole number of units
PART = 24  # bits of the lower part of units; parts of any number of rows add up within a long


def checked_units(value: Column, decimals: int, magnitude: float = 0.0) -> Column:
    """The value as a whole number of 10^-decimals, ``NO_UNITS`` if it is none.

    NULL if it is missing, NaN or infinite. No branch raises here: aggregates carry the largest units and
    raise once per group, so that this stays a few instructions per value.
    """
    scale = F.lit(float(10**decimals))
    units = F.rint(value * scale)
    slack = F.abs(value) * F.lit(ROUNDING)
    if magnitude:
        slack = slack + F.lit(ROUNDING * magnitude)
    whole = (F.abs(units) < F.lit(LARGEST_UNITS)) & (F.abs(units / scale - value) <= slack)
    finite = F.abs(value) < F.lit(float("inf"))
    return F.when(whole, units.cast("bigint")).when(finite, F.lit(NO_UNITS).cast("bigint"))


def _complaint(decimals: int) -> Column:
    return F.raise_error(F.lit(f"a value is no exact multiple of 1e-{decimals}")).cast("bigint")


def to_units(value: Column, decimals: int, magnitude: float = 0.0) -> Column:
    """``checked_units`` of single values: raises where there are none."""
    units = checked_units(value, decimals, magnitude)
    return F.when(units == F.lit(NO_UNITS), _complaint(decimals)).otherwise(units)


def sum_units(units: Column, decimals: int = 0, *, single: bool = True) -> Column:
    """The sum of checked units; raises an error if one is none or the sum does not fit, in any mode.

    Upper and lower bits are added apart by plain sums, which is cheaper than a sum that checks every
    addition. ``single``: the units are those of single values, not sums that are checked already.
    """
    upper = F.sum(F.shiftright(units, PART))
    lower = F.sum(units.bitwiseAND(F.lit((1 << PART) - 1)))
    carried = upper + F.shiftright(lower, PART)
    fits = F.abs(carried) < F.lit(1 << (62 - PART))
    added = F.shiftleft(carried, PART) + lower.bitwiseAND(F.lit((1 << PART) - 1))
    complaint = F.raise_error(F.lit("an exact sum is too large")).cast("bigint")
    summed = F.when(fits, added).when(~fits, complaint)
    if not single:
        return summed
    return F.when(F.max(units) == F.lit(NO_UNITS), _complaint(decimals)).otherwise(summed)


def from_units(units: Column, decimals: int) -> Column:
    return units.cast("double") / F.lit(float(10**decimals))


def total(value: Column) -> Column:
    return F.sum(value)


def mean(value: Column) -> Column:
    return F.avg(value)


def exact_total(units: Column, decimals: int) -> Column:
    return from_units(sum_units(units, decimals), decimals)


def exact_mean(units: Column, decimals: int) -> Column:
    return F.try_divide(exact_total(units, decimals), F.count(units).cast("double"))


AGGREGATES: dict[str, tuple[Callable, Callable]] = {
    "sum": (total, exact_total),
    "mean": (mean, exact_mean),
}


def _known(name: str) -> tuple[Callable, Callable]:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregation {name!r}, expected one of {list(AGGREGATES)}")
    return AGGREGATES[name]


def aggregate(
    name: str, value: Column, decimals: int | None = None, magnitude: float = 0.0
) -> Column:
    """The aggregate called ``name``; missing values are skipped, none at all gives NULL.

    Units are computed within the aggregate, where Spark shares them between its parts and compiles
    each aggregate apart; as projected columns they make one method that is too large to compile.
    """
    plain, exact = _known(name)
    if decimals is None:
        return plain(value)
    return exact(checked_units(value, decimals, magnitude), decimals)


def page_title(period: Column, site: Column) -> Column:
    return F.concat(period, F.lit(" Site "), F.upper(site))

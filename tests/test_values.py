from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cellkpi.functions.values import aggregate, page_title, to_date, to_number

NUMBERS = {
    " 1.5 ": 1.5,
    "1e3": 1000.0,
    "-2": -2.0,
    "+.5": 0.5,
    "5.": 5.0,
    "inf": math.inf,
    "-Infinity": -math.inf,
    "abc": None,
    "": None,
    "1,000": None,
    "1.0d": None,
    "2f": None,
    "NaN": None,
    "0x10": None,
    "0x1p3": None,
    "L1800": None,
    "#DIV/0!": None,
    None: None,
}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_text_to_number(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(t,) for t in NUMBERS], "t string")
        got = {r.t: r.n for r in df.select("t", to_number(F.col("t")).alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got == NUMBERS


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_dates_raise_or_become_null(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        texts = ["2023-07-01", "2023-07-02 10:00:00", None]
        good = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [r.d for r in good.select(to_date(F.col("t")).alias("d")).collect()]
        assert got == [dt.date(2023, 7, 1), dt.date(2023, 7, 2), None]
        bad = spark.createDataFrame([("07.01.2023",)], "t string")
        assert bad.select(to_date(F.col("t"), strict=False).alias("d")).first().d is None
        assert bad.select(to_date(F.col("t"), "MM.dd.yyyy").alias("d")).first().d == dt.date(
            2023, 7, 1
        )
        for fmt in (None, "yyyy/MM/dd"):
            with pytest.raises(Exception, match="not a date"):
                bad.select(to_date(F.col("t"), fmt)).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("decimals", [None, 6])
def test_aggregates_skip_missing_values(spark, decimals):
    rows = [("a", 1.25), ("a", None), ("a", 2.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v double").groupBy("k")
    got = df.agg(
        aggregate("sum", F.col("v"), decimals).alias("s"),
        aggregate("mean", F.col("v"), decimals).alias("m"),
    )
    assert {(r.k, r.s, r.m) for r in got.collect()} == {("a", 3.25, 1.625), ("b", None, None)}


def test_exact_sums_do_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e6, -1e6, 0.7] * 50
    sums = set()
    for ordered in (values, values[::-1], sorted(values)):
        df = spark.createDataFrame([(v,) for v in ordered], "v double").repartition(7)
        sums.add(df.agg(aggregate("sum", F.col("v"), 6).alias("s")).first().s)
    assert sums == {65.0}


def test_unknown_aggregate():
    with pytest.raises(ValueError):
        aggregate("median", F.lit(1))


def test_title(spark):
    row = spark.range(1).select(page_title(F.lit("Weekly"), F.lit("saa108")).alias("t")).first()
    assert row.t == "Weekly Site SAA108"


@pytest.fixture(params=["true", "false"])
def any_mode(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


def exact(spark, values, how="sum", decimals=6):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    return df.agg(aggregate(how, F.col("v"), decimals).alias("s")).first().s


@pytest.mark.parametrize(
    "values", [[1e-7] * 10, [0.5, 1e13], [9e15], [-1e300], [5e-11], [1.00000000005], [1.0, 1e-15]]
)
def test_values_without_exact_units_raise(spark, any_mode, values):
    with pytest.raises(Exception, match="no exact multiple"):
        exact(spark, values)


def test_sums_that_do_not_fit_raise(spark, any_mode):
    assert exact(spark, [9e9] * 2) == 1.8e10
    with pytest.raises(Exception, match="too large"):
        exact(spark, [9e9] * 1100)


def test_exact_sums_skip_what_is_not_finite(spark, any_mode):
    odd = [math.nan, math.inf, -math.inf, None]
    assert exact(spark, [*odd, 1.5, 2.5]) == 4.0
    assert exact(spark, [*odd, 1.5, 2.5], "mean") == 2.0
    assert exact(spark, odd) is None and exact(spark, odd, "mean") is None


def test_units_survive_a_complement(spark):
    from cellkpi.operators.measures import COMPLEMENTED, units_of

    values = [n / 100 for n in range(9901, 10001)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rate = df.select((F.lit(100) - F.col("x")).alias(COMPLEMENTED))
    units = rate.select(units_of(COMPLEMENTED, 6)).collect()
    assert [r[0] for r in units] == [10_000 * (10_000 - n) for n in range(9901, 10001)]


def test_units_survive_a_change_of_unit(spark):
    values = [n / 100 / 1000 for n in range(1, 3000, 7)]
    assert exact(spark, values) == sum(range(1, 3000, 7)) / 1e5


def test_date_formats_are_tried_in_order(spark):
    df = spark.createDataFrame([("7/1/2023",), ("2023-07-02",), ("x",)], "t string")
    formats = ["yyyy-MM-dd", "M/d/yyyy"]
    got = [r.d for r in df.select(to_date(F.col("t"), formats, strict=False).alias("d")).collect()]
    assert got == [dt.date(2023, 7, 1), dt.date(2023, 7, 2), None]

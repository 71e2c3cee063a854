from __future__ import annotations

import datetime as dt

import pytest
from helpers import facts, values
from pyspark.sql import functions as F

from cellkpi.functions.buckets import bucket, hour_start
from cellkpi.operators.measures import scale_measures, with_hour_timestamp


def expected(period: str, d: dt.date) -> dt.date:
    return {
        "Daily": d,
        "Weekly": d - dt.timedelta(days=d.weekday()),
        "Monthly": d.replace(day=1),
    }[period]


@pytest.mark.parametrize("period", ["Daily", "Weekly", "Monthly"])
def test_date_buckets(spark, period):
    days = [dt.date(2023, 6, 20) + dt.timedelta(days=n) for n in range(600)]
    df = spark.createDataFrame([(d,) for d in days], "DATE_ID date")
    got = {r.DATE_ID: r.b for r in df.select("DATE_ID", bucket(period).alias("b")).collect()}
    assert got == {d: expected(period, d) for d in days}


def test_week_and_month_labels_may_precede_the_data(spark):
    df = spark.createDataFrame([(dt.date(2023, 7, 1),)], "DATE_ID date")
    row = df.select(bucket("Weekly").alias("w"), bucket("Monthly").alias("m")).first()
    assert row.w == dt.date(2023, 6, 26) and row.m == dt.date(2023, 7, 1)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "Asia/Jakarta", "America/New_York"])
def test_hours_do_not_depend_on_the_session_zone(spark, zone):
    # 2023-03-26 02:00 and 2023-03-12 02:00 do not exist in two of these zones.
    rows = [
        {"DATE_ID": d, "HOUR_ID": h} for d in ("2023-03-26", "2023-03-12") for h in range(0, 24)
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        timed = with_hour_timestamp(facts(spark, rows, "hourly"))
        got = values(
            timed.select(
                bucket("Hourly").cast("string").alias("b"),
                F.col("DATE_ID").cast("string").alias("t"),
            ),
            "b",
            "t",
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    wanted = [f"{r['DATE_ID']} {r['HOUR_ID']:02}:00:00" for r in rows]
    assert got == sorted((w, w) for w in wanted)


def test_hour_start_drops_minutes(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2023-07-02 13:59:59.5' AS t")
    assert df.select(hour_start(F.col("t")).alias("h")).first().h == dt.datetime(2023, 7, 2, 13)


def test_hours_roll_over_and_may_be_missing(spark):
    rows = [{"DATE_ID": "2023-07-02", "HOUR_ID": h} for h in (0, 25, None)]
    timed = with_hour_timestamp(facts(spark, rows, "hourly"))
    assert "HOUR_ID" not in timed.columns
    assert {r.DATE_ID for r in timed.collect()} == {
        dt.datetime(2023, 7, 2, 0),
        dt.datetime(2023, 7, 3, 1),
        None,
    }


def test_unknown_period():
    with pytest.raises(ValueError):
        bucket("Yearly")


def test_units(spark):
    row = {
        "LTE_CSFB_SR": 97.5,
        "Total_Traffic_Volume": 1500.0,
        "Downlink_Traffic_Volume": 1000.0,
        "Uplink_Traffic_Volume": None,
    }
    daily = scale_measures(facts(spark, [row, {}]), "daily")
    columns = ["LTE_CSFB_SR", "Total_Traffic_Volume", "Downlink_Traffic_Volume"]
    assert values(daily, *columns) == [(2.5, 1.5, 1.0), (None, None, None)]
    hourly = scale_measures(facts(spark, [row], "hourly"), "hourly")
    assert values(hourly, *columns, "Uplink_Traffic_Volume") == [(2.5, 1500.0, 1000.0, None)]
    with pytest.raises(ValueError):
        scale_measures(hourly, "weekly")

from __future__ import annotations

import datetime as dt
import re
from collections import Counter, defaultdict

import pytest
from helpers import facts, plan, values
from pyspark.sql import functions as F

from cellkpi.operators import rollups
from cellkpi.operators.axes import stack
from cellkpi.plans.catalog import CHARTS, MEAN_KPIS, TOTAL_SERIES, Chart, chart_frame, y_range
from cellkpi.plans.page import page_rows
from cellkpi.plans.report import chart_axes, out_of_range, page_report, report, stacked_areas
from cellkpi.registry.queries import FACTS, rows_for
from cellkpi.session import scratch_path
from cellkpi.sources.mapped import DECIMALS, cell_daily
from cellkpi.sources.tables import read_facts, write_facts


def d(text):
    return dt.date.fromisoformat(text)


# The catalogue


def test_catalogue():
    assert len(CHARTS) == 59 and [c.item_id for c in CHARTS] == list(range(1, 60))
    assert Counter(c.agg for c in CHARTS) == {"sum": 14, "mean": 45}
    assert Counter(c.sector for c in CHARTS) == {"All": 2, "1": 19, "2": 19, "3": 19}
    assert len({c.kpi for c in CHARTS}) == 16 and len(MEAN_KPIS) == 15
    assert [c.item_id for c in CHARTS if c.shape == "area"] == [1, 3, 4, 5, 12, 13, 14]


def test_value_ranges():
    assert y_range("DL PRB - Sec 1") == (None, 100.0)
    assert y_range("RRCSR - Sec 2") == (90.0, 100.0)
    assert y_range("UL PRB - Sec 1") == y_range("Payload - Site") == (None, None)


def test_catalogue_frame_is_local(spark):
    assert "LocalTableScan" in plan(chart_frame(spark))
    assert chart_frame(spark).count() == 59


# Semantics on hand-made rows


def row(cell, day, traffic=None, **kpis):
    return {"EUTRANCELLFDD": cell, "DATE_ID": day, "Total_Traffic_Volume": traffic, **kpis}


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        row("SAA108ML1", "2023-07-01", 1500.0, SE_2=1.0),
        row("SAA108ML1", "2023-07-01", 500.0, SE_2=1.0),
        row("SAA108ML1", "2023-07-01", 0.0, SE_2=1.0),
        row("SAA108ML1", "2023-07-02", 1000.0, SE_2=5.0),
        row("SAA108MR4", "2023-07-02", None),
        row("SAA108ME2", "2023-07-20", 4000.0, RRC_Setup_Success_Rate_Service=89.0),
        row("SAA108ML7", "2023-07-20", 8000.0),
        row("SAA108MM1", "2023-07-20", 9000.0),
        row("SAA109ML1", "2023-07-20", 3000.0, RRC_Setup_Success_Rate_Service=100.0),
    ]
    return page_rows(facts(spark, rows), "daily")


@pytest.mark.parametrize("decimals", [None, DECIMALS])
def test_weekly_sums(small, decimals):
    total = rollups.traffic_total(small, "Weekly", decimals)
    assert values(total, "site", "bucket", rollups.TRAFFIC) == [
        ("saa108", d("2023-06-26"), 3.0),
        ("saa108", d("2023-07-17"), 12.0),
        ("saa109", d("2023-07-17"), 3.0),
    ]
    by_band = rollups.traffic_by_band(small, "Weekly", decimals)
    assert values(by_band, "site", "bucket", "Band", rollups.TRAFFIC) == [
        ("saa108", d("2023-06-26"), "L1800", 3.0),
        ("saa108", d("2023-06-26"), "L2100", None),
        ("saa108", d("2023-07-17"), "L1800", 8.0),
        ("saa108", d("2023-07-17"), "L2300", 4.0),
        ("saa109", d("2023-07-17"), "L1800", 3.0),
    ]


@pytest.mark.parametrize("decimals", [None, DECIMALS])
def test_means_are_over_rows(small, decimals):
    got = rollups.means_by_sector_cell(small, "Weekly", ["SE_2"], decimals)
    means = {(r.EUTRANCELLFDD, r.bucket): r.SE_2 for r in got.collect()}
    assert means[("SAA108ML1", d("2023-06-26"))] == 2.0
    assert means[("SAA108MR4", d("2023-06-26"))] is None
    assert "SAA108ML7" not in {cell for cell, _ in means}


def test_report_of_a_page(small):
    rows = report(small, "Weekly").collect()
    assert {r.page for r in rows} == {"Weekly Site SAA108", "Weekly Site SAA109"}
    one = defaultdict(set)
    for r in rows:
        if r.site == "saa108":
            one[r.item_id].add((r.series, r.bucket, r.value))
    assert one[2] == {("Total", d("2023-06-26"), 3.0), ("Total", d("2023-07-17"), 12.0)}
    # Sector 1 holds the cells ending in 1 and 4; no chart of sector 3 has rows.
    assert one[3] == {("L1800", d("2023-06-26"), 3.0), ("L2100", d("2023-06-26"), None)}
    assert one[4] == {("L2300", d("2023-07-17"), 4.0)}
    assert one[9] == one[12] == {
        ("SAA108ML1", d("2023-06-26"), 3.0),
        ("SAA108MR4", d("2023-06-26"), None),
    }
    assert not one[5] and not one[11]


def test_first_bucket_is_per_chart(small):
    axes = {(r.site, r.item_id): r.first_bucket for r in chart_axes(small, "Weekly").collect()}
    assert axes[("saa108", 1)] == axes[("saa108", 3)] == d("2023-06-26")
    assert axes[("saa108", 4)] == d("2023-07-17")
    assert ("saa108", 5) not in axes
    shown = {(r.site, r.item_id) for r in report(small, "Weekly").collect()}
    assert shown == set(axes)


def test_out_of_range(small):
    got = values(out_of_range(small, "Weekly"), "site", "item_id", "series", "value")
    assert got == [("saa108", 28, "SAA108ME2", 89.0)]


def test_custom_catalogue(small):
    charts = [
        Chart(1, "Efficiency - Site", "SE_2", "Band", "All", "mean", "line", None, 2.5),
        Chart(2, "Efficiency - Sec 1", "SE_2", "EUTRANCELLFDD", "1", "sum", "line", None, None),
    ]
    for decimals in (None, DECIMALS):
        rows = report(small, "Monthly", charts=charts, decimals=decimals).where("site = 'saa108'")
        got = {(r.item_id, r.series): (r.value, r.out_of_range) for r in rows.collect()}
        assert got == {
            (1, "L1800"): (2.0, False),
            (1, "L2100"): (None, False),
            (1, "L2300"): (None, False),
            (2, "SAA108ML1"): (8.0, False),
            (2, "SAA108MR4"): (None, False),
        }
    with pytest.raises(ValueError):
        report(small, "Monthly", charts=[])
    with pytest.raises(ValueError):
        report(small, "Monthly", charts=[charts[0]._replace(series_key="AREA")])
    with pytest.raises(ValueError):
        report(small, "Monthly", charts=[charts[0]._replace(agg="median")])


def test_stack_counts_missing_values_as_zero(spark):
    rows = [("p", "b", 2.0), ("p", "a", 1.0), ("p", "c", None), ("p", "d", 4.0), ("q", "a", 9.0)]
    df = spark.createDataFrame(rows, "k string, series string, value double")
    for decimals in (None, DECIMALS):
        got = values(stack(df, ["k"], decimals), "k", "series", "stack_top")
        assert got == [
            ("p", "a", 1.0),
            ("p", "b", 3.0),
            ("p", "c", 3.0),
            ("p", "d", 7.0),
            ("q", "a", 9.0),
        ]


def test_rows_without_an_hour_are_counted_not_rolled_up(spark):
    rows = [{**row("SAA108ML1", "2023-07-01", 1.0), "HOUR_ID": h} for h in (5, None, None)]
    page = page_rows(facts(spark, rows, "hourly"), "hourly")
    assert values(rollups.traffic_total(page, "Hourly"), "bucket", rollups.TRAFFIC) == [
        (dt.datetime(2023, 7, 1, 5), 1.0)
    ]
    assert values(rollups.untimed_rows(page), "site", "rows") == [("saa108", 2)]
    assert {r.bucket for r in report(page, "Hourly").collect()} == {dt.datetime(2023, 7, 1, 5)}


def test_empty_page_has_the_report_schema(spark, small):
    empty = report(page_rows(facts(spark, []), "daily"), "Weekly")
    assert empty.schema == report(small, "Weekly").schema and empty.count() == 0


def test_page_report_is_the_report_of_its_rows(spark, sf_dir):
    daily = cell_daily(spark, sf_dir)
    scope = {"site": "saa007", "start": "1996-01-01", "end": "1997-12-31", "bands": ["L1800"]}
    one = page_report(daily, "daily", "Monthly", decimals=DECIMALS, **scope)
    rows = page_rows(daily, "daily", **scope)
    columns = ["page", "item_id", "bucket", "series", "value"]
    assert values(one, *columns) == values(report(rows, "Monthly", decimals=DECIMALS), *columns)
    assert {r.page for r in one.collect()} == {"Monthly Site SAA007"}
    for grain, period in (("daily", "Hourly"), ("hourly", "Weekly"), ("yearly", "Daily")):
        with pytest.raises(ValueError):
            page_report(daily, grain, period)


# Properties over the mapped tables


@pytest.mark.parametrize("period", list(FACTS))
def test_sums_agree_between_levels(spark, sf_dir, period):
    rows = rows_for(spark, sf_dir, period)
    keys = ["site", "bucket"]

    def summed(df, by):
        return values(df.groupBy(*by).agg(F.round(F.sum(rollups.TRAFFIC), 6).alias("v")), *by, "v")

    total = rollups.traffic_total(rows, period, DECIMALS)
    assert summed(rollups.traffic_by_band(rows, period, DECIMALS), keys) == summed(total, keys)
    by_cell = rollups.traffic_by_sector_cell(rows, period, DECIMALS)
    by_band = rollups.traffic_by_sector_band(rows, period, DECIMALS)
    assert summed(by_cell, [*keys, "Sector"]) == summed(by_band, [*keys, "Sector"])


def test_periods_share_one_total(spark, sf_dir):
    sums = set()
    for period in ("Daily", "Weekly", "Monthly"):
        total = rollups.traffic_total(rows_for(spark, sf_dir, period), period, DECIMALS)
        sums.add(total.agg(F.round(F.sum(rollups.TRAFFIC), 6)).first()[0])
    assert len(sums) == 1


@pytest.mark.parametrize("decimals", [None, DECIMALS])
def test_report_equals_chart_by_chart_rollups(spark, sf_dir, decimals):
    """Against plain Python over the collected rows, for every chart of every site."""
    rows = rows_for(spark, sf_dir, "Monthly")
    kpis = sorted({c.kpi for c in CHARTS})
    raw = rows.select("site", "DATE_ID", "Band", "Sector", "EUTRANCELLFDD", *kpis).collect()
    brute = defaultdict(list)
    for r in raw:
        month = r.DATE_ID.replace(day=1)
        for c in CHARTS:
            if c.sector in ("All", r.Sector):
                series = TOTAL_SERIES if c.series_key == TOTAL_SERIES else r[c.series_key]
                brute[(r.site, c.item_id, month, series)].append(r[c.kpi])
    how = {c.item_id: c.agg for c in CHARTS}

    def value(item, seen):
        seen = [v for v in seen if v is not None]
        if not seen:
            return None
        return sum(seen) if how[item] == "sum" else sum(seen) / len(seen)

    got = {
        (r.site, r.item_id, r.bucket, r.series): r.value
        for r in report(rows, "Monthly", decimals=decimals).collect()
    }
    assert got.keys() == brute.keys()
    for key, seen in brute.items():
        wanted = value(key[1], seen)
        assert got[key] == (wanted if wanted is None else pytest.approx(wanted, rel=1e-9)), key


def test_stack_ends_at_the_total(spark, sf_dir):
    rows = stacked_areas(rows_for(spark, sf_dir, "Weekly"), "Weekly", decimals=DECIMALS)
    per_chart = rows.groupBy("site", "item_id", "bucket").agg(
        F.max("stack_top").alias("top"), F.sum("value").alias("total")
    )
    assert per_chart.where("abs(top - total) > 1e-6").count() == 0


# Skew: a third of all rows under one cell


def test_hot_cell(spark):
    hot = spark.range(20_000).selectExpr("'SAA108ML1' AS EUTRANCELLFDD", "id AS n")
    cold = spark.range(40_000).selectExpr(
        "concat('SAA', lpad(cast(id % 500 AS string), 3, '0'), 'MR', id % 4) AS EUTRANCELLFDD",
        "id AS n",
    )
    kpis = {k: F.lit(1.0) for k in {c.kpi for c in CHARTS}}
    weekday = (F.col("n") % 7).cast("int")
    df = hot.union(cold).withColumn("DATE_ID", F.date_add(F.lit(d("2023-07-03")), weekday))
    for name in ("Downlink_Traffic_Volume", "Uplink_Traffic_Volume"):
        kpis[name] = F.lit(1.0)
    rows = page_rows(df.withColumns(kpis), "daily")
    got = report(rows, "Weekly", decimals=DECIMALS).where("item_id = 9 AND series = 'SAA108ML1'")
    assert [(r.bucket, r.value) for r in got.collect()] == [(d("2023-07-03"), 20.0)]


# Plans


def test_rollup_plan_has_one_exchange_and_no_sort(spark, sf_dir):
    rows = rows_for(spark, sf_dir, "Weekly")
    for df in (
        rollups.traffic_by_band(rows, "Weekly", DECIMALS),
        rollups.means_by_sector_cell(rows, "Weekly", MEAN_KPIS, DECIMALS),
    ):
        text = plan(df)
        assert text.count("Exchange hashpartitioning") == 1
        assert "functions=[partial_" in text  # whatever aggregates exact sums are made of
        for node in ("Sort", "Python", "Cartesian", "NestedLoop", "Window"):
            assert node not in text.replace("SortOrder", ""), node


def test_report_plan(spark, sf_dir):
    text = plan(report(rows_for(spark, sf_dir, "Weekly"), "Weekly", decimals=DECIMALS))
    lines = text.splitlines()
    # By cell, by band, and the roll-up of the latter; no one keyed by site alone.
    assert sum("Exchange hashpartitioning" in line for line in lines) == 3
    assert sum("FileScan" in line for line in lines) == 2
    assert not re.search(r"hashpartitioning\(site#\d+, \d+\)", text)
    for node in ("SortAggregate", "ObjectHashAggregate", "Python", "Cartesian", "NestedLoop"):
        assert node not in text, node


def test_report_joins_nothing_by_site(spark, sf_dir):
    """Without room for a broadcast only the catalogue is joined, with equal rows."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    rows = rows_for(spark, sf_dir, "Monthly")
    columns = ["site", "item_id", "bucket", "series", "value"]
    small = values(report(rows, "Monthly", decimals=DECIMALS), *columns)
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = report(rows, "Monthly", decimals=DECIMALS)
        assert "SortMergeJoin" not in plan(df)
        assert small == values(df, *columns)
    finally:
        spark.conf.set(key, before)


def test_stored_facts_give_the_same_report(spark, sf_dir):
    path = scratch_path(spark, "facts")
    facts_frame = cell_daily(spark, sf_dir).where("DATE_ID < '1996-01-01'")
    write_facts(facts_frame, path)
    columns = ["site", "item_id", "bucket", "series", "value"]
    results = [
        values(report(page_rows(f, "daily"), "Weekly", decimals=DECIMALS), *columns)
        for f in (facts_frame, read_facts(spark, path))
    ]
    assert results[0] == results[1]
    text = plan(report(page_rows(read_facts(spark, path), "daily"), "Weekly"))
    read = [line.split("ReadSchema")[1] for line in text.splitlines() if "FileScan" in line]
    assert read and all("AREA" not in columns and "NEID" not in columns for columns in read)

from __future__ import annotations

import datetime as dt

import pytest
from helpers import facts, values

from cellkpi.operators.filters import (
    dates_between,
    default_dates,
    in_bands,
    in_sector,
    site_contains,
    site_is,
)
from cellkpi.plans.page import page_rows

NAMES = ["SAA108ML1", "saa108ml1", "SAA118ML1", "XSAA108ML1", "SAA109MR2", None]


@pytest.fixture(scope="module")
def named(spark):
    rows = [{"EUTRANCELLFDD": n, "DATE_ID": "2023-07-01"} for n in NAMES]
    return facts(spark, rows)


def kept(df):
    return {r.EUTRANCELLFDD for r in df.collect()}


def test_site_contains_any_case_anywhere(named):
    assert kept(site_contains(named, "SAA108")) == {"SAA108ML1", "saa108ml1", "XSAA108ML1"}


def test_site_text_may_hold_wildcards(named):
    assert kept(site_contains(named, "saa1_8")) == {
        "SAA108ML1",
        "saa108ml1",
        "SAA118ML1",
        "XSAA108ML1",
    }


def test_site_is_compares_the_prefix(named):
    assert kept(site_is(named, "Saa108")) == {"SAA108ML1", "saa108ml1"}


@pytest.mark.parametrize("site", ["", "saa10", "saa1080"])
def test_site_has_six_characters(named, site):
    for match in (site_contains, site_is):
        with pytest.raises(ValueError):
            match(named, site)


def test_date_range_includes_both_ends(spark):
    days = ["2023-06-30", "2023-07-01", "2023-07-02", "2023-07-03", None]
    df = facts(spark, [{"DATE_ID": d} for d in days])
    inside = dates_between(df, "2023-07-01", dt.date(2023, 7, 2))
    assert values(inside, "DATE_ID") == [(dt.date(2023, 7, 1),), (dt.date(2023, 7, 2),)]
    assert dates_between(df, "2023-07-02", "2023-07-01").count() == 0
    assert dates_between(df).count() == 5


def test_bands(named):
    assert kept(in_bands(named, ["L2100"])) == {"SAA109MR2"}
    assert kept(in_bands(named)) == {"SAA108ML1", "SAA118ML1", "SAA109MR2"}
    assert kept(in_bands(named, [])) == set()
    with pytest.raises(ValueError):
        in_bands(named, ["Not Define"])


def test_band_order_does_not_matter(named):
    assert kept(in_bands(named, ["L2100", "L1800"])) == kept(in_bands(named, ["L1800", "L2100"]))


def test_sectors(named):
    assert kept(in_sector(named, "2")) == {"SAA109MR2"}
    assert kept(in_sector(named)) == {n for n in NAMES if n}


def test_last_day_keeps_its_last_hour(spark):
    rows = [
        {"EUTRANCELLFDD": "SAA108ML1", "DATE_ID": d, "HOUR_ID": h}
        for d in ("2023-07-01", "2023-07-02")
        for h in (0, 23)
    ]
    page = page_rows(
        facts(spark, rows, "hourly"), "hourly", site="saa108", start="2023-07-01", end="2023-07-01"
    )
    assert values(page, "DATE_ID") == [
        (dt.datetime(2023, 7, 1, 0),),
        (dt.datetime(2023, 7, 1, 23),),
    ]


def test_page_label_follows_the_site_mode(named):
    asked = page_rows(named, "daily", site="SAA1_8")
    assert {r.site for r in asked.collect()} == {"saa1_8"}
    exact = page_rows(named, "daily", site="SAA108", site_mode="exact")
    assert {(r.site, r.EUTRANCELLFDD) for r in exact.collect()} == {("saa108", "SAA108ML1")}
    with pytest.raises(ValueError):
        page_rows(named, "daily", site="SAA108", site_mode="guess")


def test_empty_selections_give_empty_pages(named):
    assert page_rows(named, "daily", site="zzz999").count() == 0
    assert page_rows(named, "daily", site="saa108", bands=[]).count() == 0


def test_default_dates(spark):
    one = spark.range(1)
    start, end = one.select(*default_dates("daily")).first()
    assert start == dt.date(2023, 7, 1)
    first, last = one.select(*default_dates("hourly")).first()
    assert last == end and last - first == dt.timedelta(days=3)
    with pytest.raises(ValueError):
        default_dates("yearly")


def test_date_range_takes_columns(spark):
    today = dt.datetime.now(dt.timezone.utc).date()
    days = [today - dt.timedelta(days=n) for n in range(6)]
    df = spark.createDataFrame([(d,) for d in days], "DATE_ID date")
    assert dates_between(df, *default_dates("hourly")).count() == 4

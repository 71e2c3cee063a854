from __future__ import annotations

import datetime as dt
import os

import pytest
from helpers import facts, plan, values

from cellkpi.plans.cache import PageCache, in_range
from cellkpi.plans.catalog import CHARTS
from cellkpi.plans.page import page_rows
from cellkpi.plans.partials import load_facts, refresh_partials, report_from_partials
from cellkpi.plans.report import page_report, report
from cellkpi.session import scratch_path
from cellkpi.sources.tables import latest_loaded_date, read_facts, save_facts, write_facts

COLUMNS = ("site", "item_id", "series", "bucket", "value", "out_of_range")


def some(spark, *rows):
    names = ("EUTRANCELLFDD", "DATE_ID", "Total_Traffic_Volume", "SE_2")
    return facts(spark, [dict(zip(names, r, strict=True)) for r in rows])


@pytest.fixture
def loads(spark):
    first = some(
        spark,
        ("SAA108ML1", "2023-07-01", 1000.0, 0.5),
        ("SAA108ML1", "2023-07-01", 2000.0, None),
        ("SAA108MR2", "2023-07-04", None, 1.5),
        ("SAA109ZZ2", "2023-07-04", 7.0, 1.5),
    )
    second = some(
        spark, ("SAA108ML1", "2023-07-04", 500.0, 2.25), ("SAA109MT3", "2023-07-05", 1.0, 4.0)
    )
    return first, second


FEW = [c for c in CHARTS if c.kpi in ("Total_Traffic_Volume", "SE_2")]


@pytest.mark.parametrize("mode, decimals", [("replace", 6), ("append", 6), ("reload", 6), ("reload", None)])
def test_partials_follow_every_load(spark, loads, mode, decimals):
    path, partials = scratch_path(spark, "facts"), scratch_path(spark, "partials")
    load_facts(loads[0], path, partials, "replace", decimals=decimals)
    for _ in range(1 if mode == "append" else 2):
        load_facts(loads[1], path, partials, mode, decimals=decimals)
    stored = read_facts(spark, path)
    for period, scope in (("Weekly", {}), ("Daily", {"site": "saa108", "start": "2023-07-04"})):
        how = {"decimals": decimals, "charts": FEW, **scope}
        merged = report_from_partials(read_facts(spark, partials), period, **how)
        plain = page_report(stored, "daily", period, **how)
        assert values(merged, *COLUMNS) == values(plain, *COLUMNS)


def test_reports_from_partials_read_no_facts_and_other_days_stay(spark, loads):
    path, partials = scratch_path(spark, "facts"), scratch_path(spark, "partials")
    load_facts(loads[0], path, partials, "replace", decimals=6)
    untouched = f"{partials}/DATE_ID=2023-07-01"
    before = sorted(os.listdir(untouched))
    load_facts(loads[1], path, partials, "reload", decimals=6)
    assert sorted(os.listdir(untouched)) == before
    merged = report_from_partials(read_facts(spark, partials), "Weekly", decimals=6)
    assert all("/partials-" in f for f in merged.inputFiles())
    assert "Total_Traffic_Volume:double" not in plan(merged)


def test_a_load_that_died_before_its_partials_is_completed(spark, loads):
    path, partials = scratch_path(spark, "facts"), scratch_path(spark, "partials")
    load_facts(loads[0], path, partials, "replace", decimals=6)
    write_facts(loads[1], path, "reload")
    refresh_partials(spark, path, partials, loads[1], decimals=6)
    merged = report_from_partials(read_facts(spark, partials), "Monthly", charts=FEW, decimals=6)
    plain = page_report(read_facts(spark, path), "daily", "Monthly", charts=FEW, decimals=6)
    assert values(merged, *COLUMNS) == values(plain, *COLUMNS)


def test_values_without_exact_units_raise_at_the_load(spark):
    odd = some(spark, ("SAA108ML1", "2023-07-01", 1.0, 1.00000000005))
    with pytest.raises(Exception, match="no exact multiple"):
        load_facts(odd, scratch_path(spark, "f"), scratch_path(spark, "p"), "replace", decimals=6)


def test_cache_hits_and_misses(spark, loads):
    path, folder = scratch_path(spark, "facts"), scratch_path(spark, "pages")
    write_facts(loads[0], path)
    scope = {"site": "saa108", "start": "2023-07-01", "end": "2023-07-03"}
    cache = PageCache(spark, folder)
    cache.rows(path, "daily", **scope)
    page = cache.rows(path, "daily", bands=["L1800"], **scope)
    again = PageCache(spark, folder)  # another session finds what is kept
    again.rows(path, "daily", **scope)
    assert (cache.hits, cache.misses, again.hits) == (1, 1, 1)
    assert all("/pages-" in f for f in page.inputFiles())
    plain = page_rows(read_facts(spark, path), "daily", bands=["L1800"], **scope)
    weekly = [values(report(r, "Weekly", charts=FEW), *COLUMNS) for r in (page, plain)]
    assert weekly[0] == weekly[1] != []

    write_facts(loads[1], path, "append")  # days beyond the range
    cache.rows(path, "daily", **scope)
    assert (cache.hits, cache.misses) == (2, 1)
    write_facts(some(spark, ("SAA108ML1", "2023-07-01", 9.0, 9.0)), path, "reload")
    fresh = cache.rows(path, "daily", **scope)
    assert (cache.hits, cache.misses) == (2, 2)
    assert values(fresh, "SE_2") == [(9.0,)]
    other = {**scope, "site": "saa109"}
    cache.rows(path, "daily", **other)
    cache.rows(path, "daily", **{**scope, "end": "2023-07-09"})
    cache.rows(path, "daily", site_mode="exact", **scope)
    assert (cache.hits, cache.misses) == (2, 5)
    cache.clear()
    cache.rows(path, "daily", **scope)
    assert cache.misses == 6


def test_half_an_entry_is_not_used(spark, loads):
    path, folder = scratch_path(spark, "facts"), scratch_path(spark, "pages")
    write_facts(loads[0], path)
    cache = PageCache(spark, folder)
    cache.rows(path, "daily", site="saa108")
    entry = next(e for e in os.listdir(folder) if not e.startswith("."))
    os.remove(f"{folder}/{entry}/_SUCCESS")
    os.rename(f"{folder}/{entry}", f"{folder}/.half")
    rows = cache.rows(path, "daily", site="saa108")
    assert cache.misses == 2 and rows.count() == 3


def test_files_in_range():
    file = "file:/f/DATE_ID=2023-07-02/part-0.parquet"
    assert in_range(file, None, None) and in_range(file, "2023-07-02", "2023-07-02")
    assert not in_range(file, "2023-07-03", None) and not in_range(file, None, "2023-07-01")
    assert in_range("file:/f/part-0.parquet", "2023-07-03", None)


def test_latest_day_is_read_from_folder_names(spark, loads):
    path = scratch_path(spark, "facts")
    nothing = latest_loaded_date(spark, path).first()
    assert nothing.most_recent_date is None
    write_facts(loads[0].unionByName(some(spark, ("SAA108ML1", None, 1.0, 1.0))), path)
    os.makedirs(f"{path}/DATE_ID=2023-08-01")  # left empty by a load that failed
    os.makedirs(f"{path}/DATE_ID=2023-08-02/_temporary")
    found = latest_loaded_date(spark, path)
    assert found.first().most_recent_date == dt.date(2023, 7, 4)
    assert "FileScan" not in plan(found) and found.inputFiles() == []


def test_catalog_loads_refuse_a_streams_folder(spark, loads):
    path = scratch_path(spark, "facts")
    write_facts(loads[0], path)
    spark.sql(f"CREATE TABLE streamed USING parquet LOCATION '{path}'")
    os.makedirs(f"{path}/_spark_metadata")
    for mode in ("append", "replace", "reload"):
        with pytest.raises(ValueError, match="stream"):
            save_facts(loads[1], "streamed", mode)
    spark.sql("DROP TABLE streamed")

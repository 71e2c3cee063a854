from __future__ import annotations

import datetime as dt

import pytest
from helpers import facts, plan, values

from cellkpi.operators.filters import dates_between, in_bands, site_is
from cellkpi.plans.export import export_rows, preview, write_csv
from cellkpi.plans.page import cached, page_rows
from cellkpi.session import scratch_path
from cellkpi.sources.extracts import clean_extract, read_extract
from cellkpi.sources.mapped import cell_hourly
from cellkpi.sources.tables import latest_date, read_facts, save_facts, write_facts
from cellkpi.streaming.append import append_facts, stream_extracts

KEY = ("EUTRANCELLFDD", "DATE_ID", "SE_2")


def some(spark, *rows):
    return facts(spark, [{"EUTRANCELLFDD": c, "DATE_ID": d, "SE_2": v} for c, d, v in rows])


@pytest.fixture
def two_loads(spark):
    first = some(
        spark, ("SAA108ML1", "2023-07-01", 1.0), ("SAA108ML1", "2023-07-02", 2.0)
    )
    second = some(
        spark, ("SAA108ML1", "2023-07-02", 9.0), ("SAA109MR1", "2023-07-03", 3.0)
    )
    return first, second


def expected(mode, first, second):
    if mode == "replace":
        return values(second, *KEY)
    if mode == "append":
        return values(first.unionByName(second), *KEY)
    return values(first.where("DATE_ID = '2023-07-01'").unionByName(second), *KEY)


@pytest.mark.parametrize("mode", ["replace", "append", "reload"])
def test_write_modes(spark, two_loads, mode):
    first, second = two_loads
    path = scratch_path(spark, "facts")
    write_facts(first, path)
    write_facts(second, path, mode)
    assert values(read_facts(spark, path), *KEY) == expected(mode, first, second)


@pytest.mark.parametrize("mode", ["replace", "append", "reload"])
def test_save_modes(spark, two_loads, mode):
    first, second = two_loads
    table = f"facts_{mode}"
    save_facts(first, table)
    save_facts(second, table, mode)
    assert values(spark.table(table), *KEY) == expected(mode, first, second)


def test_reload_is_idempotent(spark, two_loads):
    first, _ = two_loads
    path = scratch_path(spark, "facts")
    for _ in range(3):
        write_facts(first, path, "reload")
    assert values(read_facts(spark, path), *KEY) == values(first, *KEY)


def test_unknown_mode(spark, two_loads):
    with pytest.raises(ValueError):
        write_facts(two_loads[0], scratch_path(spark, "facts"), "merge")


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    path = scratch_path(spark, "facts")
    write_facts(cell_hourly(spark, sf_dir), path)
    return read_facts(spark, path)


def test_dates_prune_partitions_and_sites_reach_the_scan(stored):
    df = in_bands(site_is(dates_between(stored, "2024-01-03", "2024-01-05"), "saa007"))
    text = plan(df.select("EUTRANCELLFDD", "SE_2"))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    filters = scan.split("PartitionFilters: ")[1]
    assert "DATE_ID" in filters.split("PushedFilters")[0]
    assert "EqualTo(SiteKey,saa007)" in filters
    assert "In(Band" in filters
    schema = scan.split("ReadSchema: ")[1]
    assert schema.startswith(
        "struct<EUTRANCELLFDD:string,SE_2:double,Band:string,SiteKey:string>"
    ), schema


def test_latest_date_reads_no_data_column(stored, spark, sf_dir):
    assert "ReadSchema: struct<>" in plan(latest_date(stored))
    assert latest_date(stored).first() == latest_date(cell_hourly(spark, sf_dir)).first()


def test_writing_needs_no_range_sampling_and_splits_large_days(spark, sf_dir):
    from cellkpi.sources.tables import _by_day

    text = plan(_by_day(cell_hourly(spark, sf_dir), 4))
    assert "REBALANCE_PARTITIONS_BY_COL" in text
    assert "rangepartitioning" not in text


def test_a_busy_day_is_written_by_several_tasks(spark):
    rows = spark.range(0, 300_000, 1, 8).selectExpr(
        "concat('SAA', lpad(cast(id % 1000 AS string), 3, '0'), 'ML1') AS EUTRANCELLFDD",
        "if(id % 3 = 0, DATE '2023-07-01', date_add(DATE '2023-07-02', cast(id % 30 AS int)))"
        " AS DATE_ID",
        "rand(7) AS SE_2",
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "500KB")
    path = scratch_path(spark, "facts")
    try:
        write_facts(rows, path)
    finally:
        spark.conf.set(key, before)
    stored = read_facts(spark, path)
    assert stored.count() == 300_000
    files = stored.where("DATE_ID = '2023-07-01'").select("_metadata.file_path").distinct()
    assert files.count() > 1


def test_site_groups_keep_a_site_together(spark):
    rows = spark.range(0, 100_000, 1, 8).selectExpr(
        "concat('SAA', lpad(cast(id % 500 AS string), 3, '0'), 'ML1') AS EUTRANCELLFDD",
        "date_add(DATE '2023-07-02', cast(id % 2 AS int)) AS DATE_ID",
        "rand(7) AS SE_2",
    )
    files = {}
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "500KB",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        for groups in (1, 8):
            path = scratch_path(spark, "facts")
            write_facts(rows, path, site_groups=groups)
            stored = read_facts(spark, path)
            assert stored.count() == 100_000
            one = stored.where("SiteKey = 'saa004'").select("_metadata.file_path")
            files[groups] = one.distinct().count()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert files[8] < files[1]


def test_csv_export_round_trip(spark, sf_dir):
    rows = page_rows(cell_hourly(spark, sf_dir), "hourly")
    path = scratch_path(spark, "export")
    write_csv(rows, path)
    back = spark.read.option("header", True).csv(path)
    shown = export_rows(rows)
    assert back.columns == shown.columns
    assert "site" not in back.columns and "SiteKey" not in back.columns
    assert back.count() == shown.count()
    as_text = shown.select([shown[c].cast("string") for c in ("EUTRANCELLFDD", "SE_2", "Band")])
    same = back.select("EUTRANCELLFDD", "SE_2", "Band")
    assert as_text.exceptAll(same).count() == 0
    order = [(r.DATE_ID, r.EUTRANCELLFDD) for r in back.collect()]
    assert order == sorted(order)


def test_export_keeps_rows_without_an_hour(spark):
    cell = {"EUTRANCELLFDD": "SAA108ML1", "DATE_ID": "2023-07-01"}
    rows = [{**cell, "HOUR_ID": h} for h in (5, None)]
    page = page_rows(facts(spark, rows, "hourly"), "hourly")
    assert export_rows(page).count() == 2


def test_preview(spark):
    df = some(spark, *[("SAA108ML1", f"2023-07-0{d}", float(d)) for d in (3, 1, 2)])
    rows = page_rows(df, "daily")
    assert [r.DATE_ID.day for r in preview(rows, 2).collect()] == [1, 2]


def test_cached_rows_are_released(spark):
    rows = page_rows(some(spark, ("SAA108ML1", "2023-07-01", 1.0)), "daily")
    with cached(rows) as kept:
        assert kept.count() == 1 and kept.is_cached
        assert "InMemoryTableScan" in plan(rows.select("SE_2"))
    assert not rows.is_cached


def test_stream_loads_every_file_once(spark):
    folder = scratch_path(spark, "arrivals")
    path, checkpoint = scratch_path(spark, "facts"), scratch_path(spark, "checkpoint")
    loads = [
        some(spark, ("SAA108ML1", "2023-07-01", 1.0), ("SAA108MR2", "2023-07-02", 2.0)),
        some(spark, ("SAA108ML1", "2023-07-02", 3.0)),
    ]
    arrived = None
    for load in loads:
        load.coalesce(1).write.mode("append").option("header", True).csv(folder)
        arrived = load if arrived is None else arrived.unionByName(load)
        for _ in range(2):  # the second run finds nothing new
            stream = clean_extract(stream_extracts(spark, folder))
            append_facts(stream, path, checkpoint).awaitTermination()
        got = read_facts(spark, path)
        assert values(got, *KEY) == values(arrived, *KEY)
    assert {r.Band for r in got.collect()} == {"L1800", "L2100"}
    batch = clean_extract(read_extract(spark, folder))
    assert values(batch, *KEY) == values(got, *KEY)
    assert latest_date(got).first().most_recent_date == dt.date(2023, 7, 2)


def test_scratch_path_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def __init__(self, known):
            self.known = known

        def get(self, key, default=None):
            return self.known.get(key, default)

    class Session:
        def __init__(self, **known):
            self.conf = Conf({k.replace("_", "."): v for k, v in known.items()})

    with pytest.raises(ValueError):
        scratch_path(Session(spark_master="yarn"), "x")
    shared = scratch_path(Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///s/"), "x")
    assert shared.startswith("hdfs:///s/x-")

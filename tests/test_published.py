from __future__ import annotations

import os

import pytest
from helpers import facts, plan, values
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cellkpi.operators.rollups import means_by_sector_cell
from cellkpi.plans.page import page_rows
from cellkpi.session import scratch_path
from cellkpi.sources.extracts import (
    clean_extract,
    coercions,
    observe_coercions,
    read_extract,
    read_extract_rows,
    split_rows,
    stream_extract_rows,
)
from cellkpi.sources.mapped import busy_days
from cellkpi.sources.published import (
    current_version,
    publish_facts,
    release_versions,
    save_bucketed,
)
from cellkpi.sources.tables import read_facts, write_facts
from cellkpi.streaming.append import append_facts, append_rejected

KEY = ("EUTRANCELLFDD", "DATE_ID", "SE_2")


def some(spark, value):
    return facts(spark, [{"EUTRANCELLFDD": "SAA108ML1", "DATE_ID": "2023-07-01", "SE_2": value}])


def test_readers_of_a_version_finish_on_it(spark):
    root = scratch_path(spark, "published")
    first = publish_facts(some(spark, 1.0), "shown", root)
    reader = spark.table("shown").select("SE_2")
    reader._jdf.queryExecution().executedPlan()  # planned before the replace
    second = publish_facts(some(spark, 2.0), "shown", root)
    assert [r.SE_2 for r in reader.collect()] == [1.0]
    assert [r.SE_2 for r in spark.table("shown").collect()] == [2.0]
    assert current_version(spark, "shown") == second
    assert len(release_versions(spark, "shown", root)) == 1 and not os.path.exists(first)
    assert spark.table("shown").count() == 1
    assert "PartitionFilters: [isnotnull(DATE_ID" in plan(spark.table("shown").where("DATE_ID > '2023-01-01'"))


def test_a_failed_replace_leaves_the_old_rows(spark):
    root = scratch_path(spark, "published")
    publish_facts(some(spark, 1.0), "kept", root)
    broken = some(spark, 2.0).withColumn("SE_2", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        publish_facts(broken, "kept", root)
    assert [r.SE_2 for r in spark.table("kept").collect()] == [1.0]


def test_bucketed_facts_need_no_shuffle_per_cell(spark, sf_dir):
    source = busy_days(spark, sf_dir, "year")
    save_bucketed(source, "bucketed", 4)
    kpis = ["SE_2", "Average_CQI_nonHOME"]
    for period in ("Daily", "Monthly"):
        found = means_by_sector_cell(page_rows(spark.table("bucketed"), "daily"), period, kpis, 6)
        assert "Exchange" not in plan(found)
        plain = means_by_sector_cell(page_rows(source, "daily"), period, kpis, 6)
        columns = ("site", "bucket", "EUTRANCELLFDD", *kpis)
        assert values(found, *columns) == values(plain, *columns)


def test_a_large_bucket_is_written_by_many_tasks(spark):
    row = {"EUTRANCELLFDD": "SAA108ML1", "DATE_ID": "2023-07-01"}
    source = facts(spark, [{**row, "SE_2": float(i), "UL_RSSI_dbm": i * 0.7} for i in range(4000)]).repartition(8)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "8k")
    try:
        save_bucketed(source, "large_bucket", 2)
    finally:
        spark.conf.unset(size)
    stored = spark.table("large_bucket")
    sizes = stored.groupBy(F.input_file_name()).count().collect()
    assert len(sizes) > 3 and max(r["count"] for r in sizes) <= 1000
    assert not [c for c in stored.columns if c.startswith("bucket")]
    found = means_by_sector_cell(page_rows(stored, "daily"), "Daily", ["SE_2"], 6)
    assert "Exchange" not in plan(found)
    assert values(found, "EUTRANCELLFDD", "SE_2") == [("SAA108ML1", 1999.5)]


HEADER = "AREA,DATE_ID,ERBS,EUTRANCELLFDD,SE (2)\n"
GOOD = 'a,2023-07-01,x,SAA108ML1,1.5\n"b, c",2023-07-02,x,SAA108ML2,n/a\n,,x,SAA108ML3,\n'
BAD = "a,2023-07-01,x,SAA108ML4\na,2023-07-01,x,SAA108ML5,1,2\na,yesterday,x,SAA108ML6,1\n"


@pytest.fixture
def extracts(spark):
    folder = scratch_path(spark, "extracts").removeprefix("file:")
    os.makedirs(folder)
    for name, text in (("one.csv", GOOD + BAD), ("two.csv", GOOD)):
        with open(f"{folder}/{name}", "w") as file:
            file.write(HEADER + text)
    return folder


REASONS = ["not a date", "not as wide as the header", "not as wide as the header"]


def test_a_load_goes_on_past_bad_rows(spark, extracts):
    loaded, rejected = split_rows(read_extract_rows(spark, extracts))
    assert loaded.count() == 6 and sorted(r.reason for r in rejected.collect()) == REASONS
    assert all(r.file.endswith("/one.csv") for r in rejected.collect())
    assert {r.row for r in rejected.collect()} == set(BAD.strip().split("\n"))
    assert loaded.columns == ["AREA", "DATE_ID", "ERBS", "EUTRANCELLFDD", "SE_2"]
    path = scratch_path(spark, "facts")
    write_facts(loaded, path)
    assert read_facts(spark, path).count() == 6
    with pytest.raises(Exception):
        clean_extract(read_extract(spark, extracts)).collect()


def test_bad_rows_of_a_stream(spark, extracts):
    path, aside = scratch_path(spark, "facts"), scratch_path(spark, "rejected")
    for _ in range(2):  # the second run finds nothing new
        loaded, rejected = split_rows(stream_extract_rows(spark, extracts))
        append_facts(loaded, path, f"{path}-checkpoint").awaitTermination()
        append_rejected(rejected, aside, f"{aside}-checkpoint").awaitTermination()
    assert read_facts(spark, path).count() == 6
    assert sorted(r.reason for r in spark.read.parquet(aside).collect()) == REASONS


def test_coercions_are_counted_by_the_write(spark, extracts):
    os.remove(f"{extracts}/one.csv")
    observation = Observation()
    raw = observe_coercions(read_extract(spark, extracts), observation)
    write_facts(clean_extract(raw), scratch_path(spark, "facts"))
    assert [tuple(r) for r in coercions(spark, observation).collect()] == [("SE_2", 1, "n/a")]

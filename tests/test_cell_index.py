from __future__ import annotations

import re

import pytest
from helpers import facts, plan, values

from cellkpi.operators.filters import site_contains
from cellkpi.plans.page import page_rows
from cellkpi.plans.report import report
from cellkpi.session import scratch_path
from cellkpi.sources.cell_index import literal_runs, matching_cells, read_matching, write_indexed_facts
from cellkpi.sources.mapped import cell_daily, odd_cells
from cellkpi.sources.tables import GROUP

KEY = ("EUTRANCELLFDD", "DATE_ID", "SE_2")


@pytest.fixture(scope="module")
def indexed(spark, sf_dir):
    path = scratch_path(spark, "indexed")
    few = odd_cells(spark, sf_dir).where("month(DATE_ID) = 5")
    write_indexed_facts(few, path, groups=16)
    return path, few


@pytest.mark.parametrize(
    "text", ["saa007", "SAA007", "s__007", "a0%7ml", "______", "%%%%%%", "7ml1__", "zzzzzz", "aa%\\_x"]
)
def test_finds_what_a_scan_finds(spark, indexed, text):
    path, few = indexed
    assert values(read_matching(spark, path, text), *KEY) == values(site_contains(few, text), *KEY)


def test_literal_runs():
    assert literal_runs("SAA007") == ["007", "a00", "aa0", "saa"]
    assert literal_runs("s__00_") == [] and literal_runs("a\\_bcd") == []
    assert literal_runs("aa0_17") == ["aa0"]


def test_groups_prune_folders_at_run_time(spark, indexed):
    path, _ = indexed
    found = read_matching(spark, path, "saa007", "1995-05-01", "1995-05-31").select("SE_2")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        text = plan(found)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [x for x in text.splitlines() if "FileScan" in x and "DATE_ID" in x]
    assert GROUP in scans[0].split("PartitionFilters")[1] and "dynamicpruning" in scans[0]
    found.collect()
    root = found._jdf.queryExecution().executedPlan()
    read = {m.group(1) for m in re.finditer(r"number of files read: (\d+)", metrics(root))}
    everything = len(spark.read.parquet(f"{path}/facts").inputFiles())
    assert read and max(map(int, read)) < 0.2 * everything, (read, everything)


def metrics(node) -> str:
    """The values of a plan's scans, as text."""
    found, todo = [], [node]
    while todo:
        here = todo.pop()
        if here.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(here.executedPlan())
            continue
        if "Scan" in here.nodeName() and "SE_2" in here.simpleString(10_000):
            found.append(f"number of files read: {here.metrics().apply('numFiles').value()}")
        if here.nodeName().endswith("QueryStage"):
            todo.append(here.plan())
        children = here.children()
        todo += [children.apply(i) for i in range(children.size())]
    return " ".join(found)


def test_a_reload_drops_groups_without_rows(spark):
    def some(*rows):
        return facts(spark, [{"EUTRANCELLFDD": c, "DATE_ID": "2023-07-01", "SE_2": v} for c, v in rows])

    path = scratch_path(spark, "indexed")
    write_indexed_facts(some(*((f"SAA{n:03}ML1", float(n)) for n in range(40))), path, groups=8)
    write_indexed_facts(some(("SAA001ML1", 9.0)), path, "reload", groups=8)
    assert values(spark.read.parquet(f"{path}/facts"), "SE_2") == [(9.0,)]


@pytest.mark.parametrize("mode", ["append", "reload"])
def test_loads_add_new_cells(spark, mode):
    def some(*rows):
        return facts(spark, [{"EUTRANCELLFDD": c, "DATE_ID": d, "SE_2": v} for c, d, v in rows])

    path = scratch_path(spark, "indexed")
    write_indexed_facts(some(("SAA108ML1", "2023-07-01", 1.0)), path, groups=4)
    more = some(("SAA108ML1", "2023-07-02", 2.0), ("XSAA108MR", "2023-07-02", 3.0))
    for _ in range(1 if mode == "append" else 2):
        write_indexed_facts(more, path, mode, groups=4)
    got = values(read_matching(spark, path, "saa108"), "EUTRANCELLFDD", "SE_2")
    assert got == [("SAA108ML1", 1.0), ("SAA108ML1", 2.0), ("XSAA108MR", 3.0)]
    assert matching_cells(spark, path, "saa108").count() == 2


def test_a_page_over_the_index(spark, sf_dir):
    path = scratch_path(spark, "indexed")
    daily = cell_daily(spark, sf_dir).where("DATE_ID < '1992-06-01'")
    write_indexed_facts(daily, path, groups=8)
    columns = ("item_id", "series", "bucket", "value")
    pages = [
        report(page_rows(source, "daily", site="saa007"), "Weekly", decimals=6)
        for source in (daily, read_matching(spark, path, "saa007"))
    ]
    assert values(pages[0], *columns) == values(pages[1], *columns)

"""Nothing is lost, split or shifted on the way in and out."""

from __future__ import annotations

import csv

import pytest
from helpers import facts

from cellkpi.plans.export import export_rows, write_csv
from cellkpi.plans.page import page_rows
from cellkpi.session import scratch_path
from cellkpi.sources.extracts import clean_extract, read_extract
from cellkpi.sources.schema import DAILY_HEADER, HOURLY_HEADER
from cellkpi.sources.tables import read_facts, save_facts, write_facts
from cellkpi.streaming.append import append_facts, stream_extracts

HEADER = "AREA,DATE_ID,ERBS,EUTRANCELLFDD,SE_2\n"
ROW = "East,2023-07-01,E1,SAA108ML1,1.5\n"


def extract(tmp_path, text, name="a.csv"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_doubled_quotes_stay_in_their_column(spark, tmp_path):
    path = extract(tmp_path, HEADER + '"East ""A"", north",2023-07-01,E1,SAA108ML1,1.5\n')
    row = clean_extract(read_extract(spark, path)).first()
    assert (row.AREA, row.ERBS, row.SE_2) == ('East "A", north', "E1", 1.5)


@pytest.mark.parametrize(
    "line", ["East,2023-07-01,E1,SAA108ML1,1.5,surplus\n", '"East\nA",2023-07-01,E1,SAA108ML1,1\n']
)
def test_rows_of_another_width_fail(spark, tmp_path, line):
    raw = read_extract(spark, extract(tmp_path, HEADER + ROW + line))
    for use in (lambda: raw.collect(), lambda: clean_extract(raw).select("SE_2").collect()):
        with pytest.raises(Exception, match="(?i)malformed"):
            use()


def test_line_breaks_in_quotes_are_read_where_asked_for(spark, tmp_path):
    path = extract(tmp_path, HEADER + '"East\nA",2023-07-01,E1,SAA108ML1,1.5\n' + ROW)
    rows = clean_extract(read_extract(spark, path, multi_line=True)).collect()
    assert [(r.AREA, r.SE_2) for r in rows] == [("East\nA", 1.5), ("East", 1.5)]


def test_header_names_are_no_schema_text(spark, tmp_path):
    path = extract(tmp_path, "a` INT, `b,c\n1,2,3\n")
    assert read_extract(spark, path).columns == ["a` INT", " `b", "c"]


def test_missing_texts_and_contract(spark, tmp_path):
    lines = HEADER + ROW.replace("East", "NA") + ROW.replace("2023-07-01", "NULL")
    raw = read_extract(spark, extract(tmp_path, lines))
    rows = clean_extract(raw).collect()
    assert [r.AREA for r in rows] == [None, "East"] and rows[1].DATE_ID is None
    assert clean_extract(raw.limit(1), missing_texts=[]).first().AREA == "NA"
    with pytest.raises(ValueError, match="missing.*pm_count.*unknown \\[\\]"):
        clean_extract(raw, grain="daily")
    assert HOURLY_HEADER.index("HOUR_ID") == 2
    whole = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in DAILY_HEADER))
    assert clean_extract(whole, grain="daily").columns[0] == "AREA"
    with pytest.raises(ValueError, match="HOUR_ID"):
        clean_extract(whole, grain="hourly")


def test_export_is_read_by_others(spark, tmp_path):
    texts = ['say "x", y', "two\nlines", " blanks ", ""]
    cell = {"DATE_ID": "2023-07-01", "EUTRANCELLFDD": "SAA108ML1"}
    rows = page_rows(facts(spark, [{**cell, "AREA": t} for t in texts]), "daily")
    path = str(tmp_path / "export")
    write_csv(rows, path)
    found = []
    for part in sorted((tmp_path / "export").glob("part-*")):
        with part.open(newline="") as file:
            found += list(csv.DictReader(file))
    assert sorted(r["AREA"] for r in found) == sorted(texts)
    assert list(found[0]) == export_rows(rows).columns


def some(spark, *days):
    return facts(spark, [{"DATE_ID": d, "EUTRANCELLFDD": "SAA108ML1"} for d in days])


def streamed(spark, tmp_path, path):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    extract(folder, HEADER + ROW)
    arrived = clean_extract(stream_extracts(spark, str(folder)))
    append_facts(arrived, path, scratch_path(spark, "checkpoint")).awaitTermination()


@pytest.mark.parametrize("mode", ["append", "replace", "reload"])
def test_batch_loads_of_a_stream_table_are_refused(spark, tmp_path, mode):
    path = scratch_path(spark, "facts")
    streamed(spark, tmp_path, path)
    with pytest.raises(ValueError, match="stream"):
        write_facts(some(spark, "2023-07-02"), path, mode)
    assert read_facts(spark, path).count() == 1


def test_streams_into_a_batch_table_are_refused(spark, tmp_path):
    path = scratch_path(spark, "facts")
    write_facts(some(spark, "2023-07-02", "2023-07-03"), path)
    with pytest.raises(ValueError, match="batch"):
        streamed(spark, tmp_path, path)
    assert read_facts(spark, path).count() == 2


def test_table_reload_leaves_the_session_alone(spark):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.sql("DROP TABLE IF EXISTS daily_facts")
    try:
        save_facts(some(spark, "2023-07-01", "2023-07-02"), "daily_facts")
        save_facts(some(spark, "2023-07-02", "2023-07-03"), "daily_facts", "reload")
        days = [str(r.DATE_ID) for r in spark.table("daily_facts").orderBy("DATE_ID").collect()]
        assert days == ["2023-07-01", "2023-07-02", "2023-07-03"]
        assert spark.conf.get(key) == before
        with pytest.raises(ValueError, match="extra"):
            more = some(spark, "2023-07-02").selectExpr("*", "1 AS extra")
            save_facts(more, "daily_facts", "reload")
    finally:
        spark.sql("DROP TABLE IF EXISTS daily_facts")

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import types as T

from cellkpi.sources.extracts import clean_extract, read_extract
from cellkpi.sources.schema import (
    DAILY_HEADER,
    HOURLY_HEADER,
    clean_name,
    clean_names,
    declared_types,
    fact_schema,
    inferred_types,
)


def write_csv(path, header, *rows):
    lines = [",".join(header)] + [",".join("" if v is None else v for v in r) for r in rows]
    path.write_text("\n".join(lines) + "\n")


def daily_row(**known):
    return [known.get(clean_name(c)) for c in DAILY_HEADER]


def test_names():
    assert clean_name("RRC Setup Success Rate (Service)") == "RRC_Setup_Success_Rate_Service"
    assert (
        clean_name("Intra-Frequency Handover Out Success Rate")
        == "Intra_Frequency_Handover_Out_Success_Rate"
    )
    for header in (DAILY_HEADER, HOURLY_HEADER):
        cleaned = [clean_name(c) for c in header]
        assert len(set(cleaned)) == len(header)
    assert (len(DAILY_HEADER), len(HOURLY_HEADER)) == (36, 37)


def test_colliding_names_are_refused(spark):
    with pytest.raises(ValueError, match="a_b"):
        clean_names(spark.createDataFrame([("1", "2")], ["a b", "a-b"]))


def test_daily_extract(spark, tmp_path):
    cell = {"AREA": "7", "ERBS": "E1", "EUTRANCELLFDD": "SAA108ML1"}
    write_csv(
        tmp_path / "daily.csv",
        DAILY_HEADER,
        daily_row(DATE_ID="2023-07-01", SE_2=" 1.5 ", pm_count="#DIV/0!", **cell),
        daily_row(DATE_ID="2023-07-02", SE_2="n/a", pm_count="24", UL_RSSI_dbm="-1e2", **cell),
    )
    df = clean_extract(read_extract(spark, str(tmp_path / "daily.csv")))
    assert [(f.name, f.dataType) for f in df.schema] == [
        (f.name, f.dataType) for f in fact_schema("daily")
    ]
    first, second = df.orderBy("DATE_ID").collect()
    assert (first.DATE_ID, first.AREA, first.SE_2) == (dt.date(2023, 7, 1), "7", 1.5)
    assert (first.pm_count, second.pm_count, second.SE_2) == (None, 24.0, None)
    assert second.UL_RSSI_dbm == -100.0 and second.volte_traffic_erl is None


def test_hourly_extract_and_text_columns(spark, tmp_path):
    row = {"DATE_ID": "2023-07-01", "HOUR_ID": "23", "Band_": "L1800", "Sector_": "1"}
    write_csv(
        tmp_path / "hourly.csv", HOURLY_HEADER, [row.get(clean_name(c)) for c in HOURLY_HEADER]
    )
    raw = read_extract(spark, str(tmp_path / "hourly.csv"))
    numbers = clean_extract(raw)
    assert numbers.schema["HOUR_ID"].dataType == T.IntegerType()
    got = numbers.first()
    assert (got.HOUR_ID, got.Band_, got.Sector_) == (23, None, 1.0)

    text = ["AREA", "DATE_ID", "ERBS", "EUTRANCELLFDD", "Band_", "Sector_", "NEID_", "SiteID_"]
    got = clean_extract(raw, text_columns=text).first()
    assert (got.Band_, got.Sector_) == ("L1800", "1")


def test_columns_are_found_by_header(spark, tmp_path):
    """A file with another column order is right on its own and refused next to an ordered one."""
    write_csv(tmp_path / "a.csv", ["DATE_ID", "EUTRANCELLFDD", "SE_2"], ["2023-07-01", "X", "1"])
    write_csv(tmp_path / "b.csv", ["SE_2", "DATE_ID", "EUTRANCELLFDD"], ["2", "2023-07-02", "Y"])
    row = clean_extract(read_extract(spark, str(tmp_path / "b.csv"))).first()
    assert (row.SE_2, row.EUTRANCELLFDD, row.DATE_ID) == (2.0, "Y", dt.date(2023, 7, 2))
    with pytest.raises(Exception):
        read_extract(spark, str(tmp_path)).collect()


def test_bad_dates(spark, tmp_path):
    write_csv(tmp_path / "a.csv", ["DATE_ID", "SE_2"], ["soon", "1"])
    raw = read_extract(spark, str(tmp_path / "a.csv"))
    with pytest.raises(Exception, match="not a date"):
        clean_extract(raw).collect()
    assert clean_extract(raw, strict_dates=False).first().DATE_ID is None
    write_csv(tmp_path / "c.csv", ["DATE_ID", "SE_2"], ["20230701", "1"])
    raw = read_extract(spark, str(tmp_path / "c.csv"))
    assert clean_extract(raw, date_format="yyyyMMdd").first().DATE_ID == dt.date(2023, 7, 1)


def test_types(spark):
    empty = spark.createDataFrame([], fact_schema("hourly"))
    declared = {r.name: r.type for r in declared_types(empty).collect()}
    assert declared["AREA"] == "STRING" and declared["DATE_ID"] == "DATE"
    assert declared["HOUR_ID"] == "INT64" and declared["SE_2"] == "FLOAT64"
    with pytest.raises(TypeError, match="flags"):
        declared_types(spark.createDataFrame([], "flags array<string>"))

    raw = spark.createDataFrame(
        [("2023-07-01", "1", "1", "1.0", "1"), ("2023-07-02", " -2 ", "", "2", "x")],
        ["DATE_ID", "whole", "gap", "point", "bad"],
    )
    got = {r.name: r.type for r in inferred_types(raw).collect()}
    assert got == {
        "DATE_ID": "DATE",
        "whole": "INT64",
        "gap": "FLOAT64",
        "point": "FLOAT64",
        "bad": "FLOAT64",
    }

from __future__ import annotations

import pytest

from cellkpi.sources.extracts import with_cell_dimensions

CASES = [
    # cell, SiteID, Band, Sector, NEID
    ("SAA108AL1", "SAA108", "L1800", "1", "SAA108ML1"),
    ("SAA108ER1", "SAA108", "L2100", "1", "SAA108MR1"),
    ("SAA108VF1", "SAA108", "L2300", "1", "SAA108ME1"),
    ("SAA108ST1", "SAA108", "L900", "1", "SAA108MT1"),
    ("SAA108MM1", "SAA108", "Not Define", "1", "SAA108MT1"),
    ("saa108ml1", "saa108", "Not Define", "1", "Not Define"),
    ("SAA108ML4", "SAA108", "L1800", "1", "SAA108ML1"),
    ("SAA108ML5", "SAA108", "L1800", "2", "SAA108ML1"),
    ("SAA108ML6", "SAA108", "L1800", "3", "SAA108ML1"),
    ("SAA108ML7", "SAA108", "L1800", "Not Define", "SAA108ML1"),
    ("SAA", "SAA", "Not Define", "Not Define", "Not Define"),
    ("", "", "Not Define", "Not Define", "Not Define"),
    (None, None, "Not Define", "Not Define", "Not Define"),
    ("XSAA108ML1", "XSAA10", "Not Define", "1", "Not Define"),
]
ALL_CODES = {
    "L1800": "AL EL IL ML SL",
    "L2100": "ER HR IR MR",
    "L2300": "ME MF IE IF MV VE VF",
    "L900": "MT ST",
}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_dimensions(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(c[0],) for c in CASES], "EUTRANCELLFDD string")
        rows = with_cell_dimensions(df).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    got = {r.EUTRANCELLFDD: (r.SiteID, r.Band, r.Sector, r.NEID) for r in rows}
    assert got == {c[0]: c[1:] for c in CASES}


def test_all_band_codes(spark):
    cells = {f"SAA001{c}1": b for b, codes in ALL_CODES.items() for c in codes.split()}
    df = spark.createDataFrame([(c,) for c in cells], "EUTRANCELLFDD string")
    rows = with_cell_dimensions(df).collect()
    assert {r.EUTRANCELLFDD: r.Band for r in rows} == cells


def test_stored_dimensions_are_kept(spark):
    df = spark.createDataFrame([("SAA108ML1", "kept")], "EUTRANCELLFDD string, Band string")
    assert with_cell_dimensions(df).first().Band == "kept"

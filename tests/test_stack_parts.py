from __future__ import annotations

import datetime as dt

import pytest
from helpers import values
from pyspark.sql import functions as F

from cellkpi.operators.axes import stack
from cellkpi.sources.extracts import choose_date_format, clean_extract


@pytest.mark.parametrize("decimals", [2, None])
def test_one_large_bucket_is_spread_and_adds_up_alike(spark, decimals):
    rows = spark.range(0, 20_000).select(
        F.when(F.col("id") % 50 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 4).alias("value"),
        F.format_string("s%06d", "id").alias("series"),
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("key"),
    )
    plain = stack(rows, ["key"], decimals)
    spread = stack(rows, ["key"], decimals, parts=7)
    columns = ("key", "series", "value", "stack_top")
    assert spread.columns == plain.columns
    assert values(spread, *columns) == values(plain, *columns)
    parts = [f for f in spread.inputFiles() if "/stack-" in f]
    assert len(parts) == 7


def test_one_format_reads_a_whole_column(spark):
    both = spark.createDataFrame([("13/04/2023",), ("04/05/2023",), ("NA",), (None,)], "DATE_ID string")
    formats = ["MM/dd/yyyy", "dd/MM/yyyy"]
    assert choose_date_format(both, formats) == "dd/MM/yyyy"
    got = [r.DATE_ID for r in clean_extract(both, date_format=formats).collect()]
    assert got == [dt.date(2023, 4, 13), dt.date(2023, 5, 4), None, None]
    torn = both.unionAll(spark.createDataFrame([("04/13/2023",)], "DATE_ID string"))
    with pytest.raises(ValueError, match="no format"):
        clean_extract(torn, date_format=formats)
    mixed = clean_extract(torn, date_format=formats, mix_formats=True).collect()
    assert mixed[-1].DATE_ID == dt.date(2023, 4, 13)

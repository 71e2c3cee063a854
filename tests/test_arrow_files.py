from __future__ import annotations

import os

import pyarrow as pa
import pytest
from helpers import values
from pyspark.sql import functions as F

from cellkpi.session import scratch_path
from cellkpi.sources.arrow_files import data_files, read_arrow, write_arrow
from cellkpi.sources.mapped import cell_hourly

KEY = ("EUTRANCELLFDD", "DATE_ID", "HOUR_ID", "SE_2", "LTE_CSFB_SR")


def test_round_trip_by_several_tasks(spark, sf_dir):
    facts = cell_hourly(spark, sf_dir).repartition(5)
    path = scratch_path(spark, "arrow")
    write_arrow(facts, path)
    back = read_arrow(spark, path)
    assert back.schema == facts.schema and values(back, *KEY) == values(facts, *KEY)
    files = data_files(path)
    assert len(files) == 5 and os.path.exists(f"{path}/_SUCCESS")
    assert not os.path.exists(f"{path}/_temporary")
    rows = sum(pa.ipc.open_file(f).read_all().num_rows for f in files)  # for any Arrow reader
    assert rows == facts.count()


def test_modes(spark):
    path = scratch_path(spark, "arrow")
    one, two = (spark.range(n).withColumn("t", F.lit("x")) for n in (3, 2))
    write_arrow(one, path)
    with pytest.raises(ValueError):
        write_arrow(two, path)
    write_arrow(two, path, "append")
    assert read_arrow(spark, path).count() == 5
    write_arrow(two, path, "overwrite")
    assert read_arrow(spark, path).count() == 2


def test_an_empty_result_keeps_its_schema(spark):
    path = scratch_path(spark, "arrow")
    nothing = spark.range(0).withColumn("d", F.lit("2023-07-01").cast("date"))
    write_arrow(nothing, path)
    back = read_arrow(spark, path)
    assert back.columns == ["id", "d"] and back.count() == 0


def test_a_task_that_dies_leaves_no_half_file(spark):
    path = scratch_path(spark, "arrow")
    write_arrow(spark.range(4), path)
    failing = F.when(F.col("id") == 39_999, F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
    broken = spark.range(0, 40_000, 1, 4).select(failing.cast("long").alias("id"))
    before = data_files(path)
    with pytest.raises(Exception, match="lost"):
        write_arrow(broken, path, "overwrite")
    assert data_files(path) == before and read_arrow(spark, path).count() == 4

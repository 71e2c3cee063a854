"""Where the time axis of a chart starts, and how area charts stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cellkpi.functions.buckets import bucket
from cellkpi.functions.cells import SECTORS
from cellkpi.functions.values import from_units, sum_units, to_units
from cellkpi.session import scratch_path

ALL_SECTORS = "All"


def first_times(rows: DataFrame) -> DataFrame:
    """The earliest time of each site, overall and per sector: one row per site.

    Buckets grow with time, so the bucket of the earliest time is the first bucket.
    """
    time = F.col("DATE_ID")
    per_sector = [F.min(F.when(F.col("Sector") == s, time)).alias(f"first_{s}") for s in SECTORS]
    return rows.groupBy("site").agg(F.min(time).alias(f"first_{ALL_SECTORS}"), *per_sector)


def first_bucket(period: str, sector: Column) -> Column:
    """The first bucket of a sector, from the columns of ``first_times``."""
    chosen = F
    for name in [ALL_SECTORS, *SECTORS]:
        chosen = chosen.when(sector == name, F.col(f"first_{name}"))
    return bucket(period, chosen)


def stack(
    values: DataFrame,
    keys: list[str],
    decimals: int | None = None,
    order: str = "series",
    parts: int | None = None,
) -> DataFrame:
    """Add ``stack_top``: the running sum of ``value`` over the series of a bucket, NULL counting 0.

    The input has one row per series already. A window group is one bucket of one chart, with as
    many rows as the chart has series, and Spark streams through it with a running frame. Where a
    bucket has so many series that one task should not hold it, give ``parts``: see ``_spread``.
    """
    known = ~F.isnan("value") & (F.abs("value") < F.lit(float("inf")))
    value = F.col("value") if decimals is None else F.when(known, F.col("value"))
    value = F.coalesce(value, F.lit(0.0))
    if decimals is not None:
        value = to_units(value, decimals)
    added = values.withColumn("stack_top", value)
    if parts:
        return _spread(added, keys, decimals, order, parts)
    below = Window.partitionBy(*keys).orderBy(order)
    below = below.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return added.withColumn("stack_top", _finished(_running("stack_top", below, decimals), decimals))


def _running(column: str, window: WindowSpec, decimals: int | None) -> Column:
    """The running sum; of units, an error where it does not fit."""
    if decimals is None:
        return F.sum(column).over(window)
    added = F.try_sum(column).over(window)
    complaint = F.raise_error(F.lit("an exact sum is too large")).cast("bigint")
    return F.when(added.isNull() & (F.count(column).over(window) > 0), complaint).otherwise(added)


def _finished(top: Column, decimals: int | None) -> Column:
    return top if decimals is None else from_units(top, decimals)


def _spread(
    values: DataFrame, keys: list[str], decimals: int | None, order: str, parts: int
) -> DataFrame:
    """The running sum as a prefix sum over parts of about equal size, whatever the buckets' sizes.

    Rows are dealt into ranges of (keys, series), so that one bucket may lie in many of them. The sums
    of each part are few, at most one row per part and one per bucket; the running sum over them
    is the height at which a part begins, and each part adds up its own rows. The ranges come from a
    sample, so the dealt rows are written to the shared scratch folder and read from there by both sides.
    """
    spark = values.sparkSession
    path = scratch_path(spark, "stack")
    dealt = values.repartitionByRange(parts, *keys, order).withColumn("part", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    total = F.sum("stack_top") if decimals is None else sum_units(F.col("stack_top"), single=False)
    sums = dealt.groupBy(*keys, "part").agg(total.alias("part_sum"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(_running("part_sum", earlier, decimals), F.lit(0).cast(sums.schema["part_sum"].dataType))
    # Keys may be NULL, as a missing series key is a group of its own.
    offsets = sums.select(*(F.col(k).alias(f"at_{k}") for k in (*keys, "part")), begins.alias("begins"))
    own = Window.partitionBy(*keys, "part").orderBy(order)
    own = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumn("stack_top", _running("stack_top", own, decimals))
    same = [F.col(k).eqNullSafe(F.col(f"at_{k}")) for k in (*keys, "part")]
    top = F.col("begins") + F.col("stack_top")
    joined = local.join(offsets, same).withColumn("stack_top", _finished(top, decimals))
    return joined.select(*values.columns)

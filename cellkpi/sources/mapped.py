"""The general test tables seen as cell counters (the mapping is described in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellkpi.functions.cells import BAND_CODES, CELL, lookup, sector
from cellkpi.operators.measures import VOLUMES

# Every mapped counter has at most two decimals, five after scaling volumes by 1000.
DECIMALS = 6

DAILY_CODES = ["ML", "MR", "ME", "MT", "MM", "VE", "ZZ"]
HOURLY_CODES = {"click": "ML", "purchase": "MR", "view": "ME", "signup": "MT", "error": "MM"}

# Raw header names of the mapped extract that differ from the cleaned ones.
RAW_NAMES = {
    "RRC_Setup_Success_Rate_Service": "RRC Setup Success Rate (Service)",
    "Intra_Frequency_Handover_Out_Success_Rate": "Intra-Frequency Handover Out Success Rate",
}


def _site(number: str) -> Column:
    return F.concat(F.lit("SAA"), F.lpad((F.col(number) % 20).cast("string"), 3, "0"))


def _cell(site: str, code: Column, digit_of: str) -> Column:
    return F.concat(F.col(site), code, (F.col(digit_of) % 8).cast("string"))


def _daily_cell() -> Column:
    codes = F.array(*[F.lit(c) for c in DAILY_CODES])
    return _cell("ERBS", F.try_element_at(codes, "l_linenumber"), "l_partkey")


def _hourly_cell() -> Column:
    return _cell("ERBS", lookup(F.col("event_type"), HOURLY_CODES), "event_id")


def _double(text: str) -> Column:
    return F.expr(text).cast("double")


def cell_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ERBS", _site("l_suppkey"))
    return lines.select(
        F.col("l_returnflag").alias("AREA"),
        F.col("l_shipdate").cast("date").alias("DATE_ID"),
        "ERBS",
        _daily_cell().alias("EUTRANCELLFDD"),
        F.col("l_extendedprice").alias("Total_Traffic_Volume"),
        (F.col("l_quantity") * 100).alias("Downlink_Traffic_Volume"),
        (F.col("l_quantity") * 10).alias("Uplink_Traffic_Volume"),
        F.nullif("l_quantity", F.lit(50.0)).alias("DL_Resource_Block_Utilizing_Rate"),
        _double("l_linenumber").alias("Average_CQI_nonHOME"),
        F.col("l_tax").alias("SE_2"),
        _double("100 - l_linenumber").alias("Radio_Network_Availability_Rate"),
        _double("85 + l_orderkey % 16").alias("RRC_Setup_Success_Rate_Service"),
        _double("85 + l_partkey % 16").alias("ERAB_Setup_Success_Rate_All"),
        _double("85 + (l_orderkey + l_partkey) % 16").alias("Session_Setup_Success_Rate"),
        F.col("l_discount").alias("Session_Abnormal_Release"),
        _double("l_orderkey % 101").alias("Intra_Frequency_Handover_Out_Success_Rate"),
        _double("l_partkey % 101").alias("inter_freq_HO"),
        (F.lit(0) - F.col("l_quantity") - 70).alias("UL_RSSI_dbm"),
        (F.col("l_quantity") + 1).alias("UL_Resource_Block_Utilizing_Rate"),
        F.col("l_extendedprice").alias("DL_PDCP_User_Throughput"),
        F.nullif("l_quantity", F.lit(1.0)).alias("User_Uplink_Average_Throughput"),
        _double("l_orderkey % 101").alias("LTE_CSFB_SR"),
    )


def cell_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns(
        {"ERBS": _site("user_id"), "k": F.get_json_object("props", "$.k").cast("double")}
    )
    return events.select(
        F.col("ts").cast("date").alias("DATE_ID"),
        F.hour("ts").alias("HOUR_ID"),
        "ERBS",
        _hourly_cell().alias("EUTRANCELLFDD"),
        F.col("value").alias("Total_Traffic_Volume"),
        (F.col("value") * 100).alias("Downlink_Traffic_Volume"),
        (F.col("value") * 10).alias("Uplink_Traffic_Volume"),
        F.nullif("k", F.lit(50.0)).alias("DL_Resource_Block_Utilizing_Rate"),
        _double("user_id % 16").alias("Average_CQI_nonHOME"),
        _double("event_id % 7").alias("SE_2"),
        _double("100 - event_id % 5").alias("Radio_Network_Availability_Rate"),
        _double("85 + user_id % 16").alias("RRC_Setup_Success_Rate_Service"),
        _double("85 + event_id % 16").alias("ERAB_Setup_Success_Rate_All"),
        _double("85 + (user_id + event_id) % 16").alias("Session_Setup_Success_Rate"),
        _double("event_id % 3").alias("Session_Abnormal_Release"),
        _double("event_id % 101").alias("Intra_Frequency_Handover_Out_Success_Rate"),
        _double("user_id % 101").alias("inter_freq_HO"),
        (F.lit(0) - F.col("k") - 70).alias("UL_RSSI_dbm"),
        (F.col("k") + 1).alias("UL_Resource_Block_Utilizing_Rate"),
        F.col("value").alias("DL_PDCP_User_Throughput"),
        F.nullif("k", F.lit(1.0)).alias("User_Uplink_Average_Throughput"),
        F.col("k").alias("LTE_CSFB_SR"),
    )


def raw_daily_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uncleaned daily extract: all text, raw names, a counter with unreadable values."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ERBS", _site("l_suppkey"))
    dirty = F.expr(
        "CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '#DIV/0!' "
        "ELSE CAST(l_quantity AS STRING) END"
    )
    return lines.select(
        F.col("l_returnflag").alias("AREA"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("DATE_ID"),
        "ERBS",
        _daily_cell().alias("EUTRANCELLFDD"),
        dirty.alias("Total_Traffic_Volume"),
        F.col("l_linenumber").cast("string").alias("pm_count"),
        F.col("l_tax").cast("string").alias("SE_2"),
        F.expr("CAST(85 + l_orderkey % 16 AS STRING)").alias(
            RAW_NAMES["RRC_Setup_Success_Rate_Service"]
        ),
        F.expr("CAST(l_orderkey % 101 AS STRING)").alias(
            RAW_NAMES["Intra_Frequency_Handover_Out_Success_Rate"]
        ),
    )


ODD_CODES = [*(code for codes in BAND_CODES.values() for code in codes), "MM", "ZZ"]


def odd_cells(spark: SparkSession, sf_dir: str, unit: str | None = None) -> DataFrame:
    """Facts whose cells have every code, and names in lower case, prefixed, cut short or missing.

    With a ``unit`` all rows of a month or year are of its first day, as in ``busy_days``.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ERBS", _site("l_suppkey"))
    codes = F.array(*[F.lit(c) for c in ODD_CODES])
    code = F.get(codes, (F.col("l_orderkey") % len(ODD_CODES)).cast("int"))
    cell = _cell("ERBS", code, "l_partkey")
    part = F.col("l_partkey")
    odd = (
        F.when(part % 23 == 0, None)
        .when(part % 19 == 0, F.substring(cell, 1, 4))
        .when(part % 17 == 0, F.lower(cell))
        .when(part % 13 == 0, F.concat(F.lit("X"), cell))
        .otherwise(cell)
    )
    day = F.col("l_shipdate").cast("date")
    return lines.select(
        odd.alias(CELL),
        (F.trunc(day, unit) if unit else day).alias("DATE_ID"),
        F.col("l_extendedprice").alias("Total_Traffic_Volume"),
        F.col("l_tax").alias("SE_2"),
        F.nullif(_double("l_orderkey % 11"), F.lit(0.0)).alias("LTE_CSFB_SR"),
    )


def whole_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily facts of whole numbers, also in page units, so that their double sums are exact."""
    facts = cell_daily(spark, sf_dir)
    counters = [name for name, kind in facts.dtypes if kind == "double"]
    whole = {c: F.floor(c).cast("double") for c in counters}
    whole.update({c: whole[c] * 1000 for c in VOLUMES})
    return facts.withColumns(whole)


def busy_days(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """Daily facts on few days of many rows, as a network has them: a month or year is one day."""
    return cell_daily(spark, sf_dir).withColumn("DATE_ID", F.trunc("DATE_ID", unit))


def missing_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily facts with a stored sector that is NULL for some rows."""
    some = F.col("LTE_CSFB_SR") % 7 == 0
    return cell_daily(spark, sf_dir).withColumn("Sector", F.when(~some, sector()))


def quoted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an extract of text columns, with quotes, commas, line breaks and gaps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    area = F.when(F.col("doc_id") % 5 == 0, "NA").otherwise(
        F.concat(F.lit(' say "x", y: '), F.col("text"), F.lit('\n"end" '))
    )
    return docs.select(
        area.alias("AREA"),
        F.lit("2023-07-01").alias("DATE_ID"),
        F.col("source").alias("ERBS"),
        F.concat(F.lit("SAA007ML"), (F.col("doc_id") % 8).cast("string")).alias(CELL),
        F.col("doc_id").cast("string").alias("SE_2"),
    )


def damaged_daily_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uncleaned daily extract with dates that are none, and values that hold a separator."""
    raw = raw_daily_text(spark, sf_dir)
    last, line = raw.columns[-1], F.col("pm_count")
    wide = F.when(line == "7", F.concat(F.col(f"`{last}`"), F.lit(",1")))
    broken = F.when(line == "6", F.concat(F.lit("x"), F.col("DATE_ID")))
    return raw.withColumns(
        {last: F.coalesce(wide, F.col(f"`{last}`")), "DATE_ID": F.coalesce(broken, F.col("DATE_ID"))}
    )

"""Columns of the two extracts and their types after cleaning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellkpi.functions.values import WHOLE_NUMBER, to_number

# Header names of the daily and the hourly extract, and the columns that stay text.
DAILY_HEADER = [
    "AREA",
    "DATE_ID",
    "ERBS",
    "EUTRANCELLFDD",
    "LTE_CSFB_SR",
    "RRC Setup Success Rate (Service)",
    "ERAB_Setup_Success_Rate_All",
    "Session_Setup_Success_Rate",
    "Session_Abnormal_Release",
    "Intra-Frequency Handover Out Success Rate",
    "Radio_Network_Availability_Rate",
    "Cell_Downlink_Average_Throughput",
    "Cell_Uplink_Average_Throughput",
    "DL_PDCP_User_Throughput",
    "User_Uplink_Average_Throughput",
    "DL_Resource_Block_Utilizing_Rate",
    "UL_Resource_Block_Utilizing_Rate",
    "Downlink_Traffic_Volume",
    "Uplink_Traffic_Volume",
    "Total_Traffic_Volume",
    "Maximum_User_Number_RrcConn",
    "pm_count",
    "Max DL Cell Downlink Throughput",
    "Max UL Cell Downlink Throughput",
    "inter_freq_HO",
    "UL_RSSI_dbm",
    "SE_2",
    "Average_CQI_nonHOME",
    "volte_traffic_erl",
    "volte_payload_DL",
    "volte_payload_UL",
    "pmCellDownTimeAuto",
    "pmCellDownTimeMan",
    "L_LATENCY_DL_ms",
    "Integrity_PacketLossRate_DL",
    "Integrity_PacketLossRate_UL",
]
HOURLY_HEADER = [
    "AREA",
    "DATE_ID",
    "HOUR_ID",
    "ERBS",
    "EUTRANCELLFDD",
    "LTE_CSFB_SR",
    "RRC Setup Success Rate (Service)",
    "ERAB_Setup_Success_Rate_All",
    "Session_Setup_Success_Rate",
    "Session_Abnormal_Release",
    "Intra-Frequency Handover Out Success Rate",
    "Radio_Network_Availability_Rate",
    "Cell_Downlink_Average_Throughput",
    "Cell_Uplink_Average_Throughput",
    "DL_PDCP_User_Throughput",
    "User_Uplink_Average_Throughput",
    "DL_Resource_Block_Utilizing_Rate",
    "UL_Resource_Block_Utilizing_Rate",
    "Downlink_Traffic_Volume",
    "Uplink_Traffic_Volume",
    "Total_Traffic_Volume",
    "Max DL Cell Downlink Throughput",
    "Max UL Cell Downlink Throughput",
    "L_LATENCY_DL_ms",
    "Integrity_PacketLossRate_DL",
    "Integrity_PacketLossRate_UL",
    "inter_freq_HO",
    "UL_RSSI_dbm",
    "SE_2",
    "Average_CQI_nonHOME",
    "volte_traffic_erl",
    "volte_payload_DL",
    "volte_payload_UL",
    "Band_",
    "Sector_",
    "NEID_",
    "SiteID_",
]
TEXT_COLUMNS = ["AREA", "DATE_ID", "ERBS", "EUTRANCELLFDD"]
HEADERS = {"daily": DAILY_HEADER, "hourly": HOURLY_HEADER}

# Texts that extracts write for a missing value.
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def check_columns(names: list[str], grain: str) -> None:
    """Raise unless cleaned column names are those of the documented extract, in any order."""
    if grain not in HEADERS:
        raise ValueError(f"unknown grain {grain!r}, expected one of {list(HEADERS)}")
    wanted = [clean_name(c) for c in HEADERS[grain]]
    missing = [c for c in wanted if c not in names]
    unknown = [c for c in names if c not in wanted]
    if missing or unknown:
        raise ValueError(f"not a {grain} extract: missing {missing}, unknown {unknown}")


def clean_name(name: str) -> str:
    """A column name that a table accepts: no blanks, brackets or hyphens."""
    return re.sub(r"[()]", "", name.replace(" ", "_")).replace("-", "_")


def clean_names(df: DataFrame) -> DataFrame:
    names = [clean_name(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names collide after cleaning: {twice}")
    return df.toDF(*names)


def fact_schema(grain: str, text_columns: list[str] | None = None) -> T.StructType:
    """The cleaned schema of an extract; ``grain`` is ``daily`` or ``hourly``."""
    keep = TEXT_COLUMNS if text_columns is None else text_columns
    kinds = {"DATE_ID": T.DateType(), "HOUR_ID": T.IntegerType()}
    return T.StructType(
        [
            T.StructField(
                clean_name(c), kinds.get(c, T.StringType() if c in keep else T.DoubleType())
            )
            for c in HEADERS[grain]
        ]
    )


# The warehouse names of the column types that extracts may have.
TYPE_NAMES = {
    T.StringType: "STRING",
    T.IntegerType: "INT64",
    T.LongType: "INT64",
    T.DoubleType: "FLOAT64",
    T.DateType: "DATE",
    T.TimestampType: "DATE",
    T.TimestampNTZType: "DATE",
}


def declared_types(df: DataFrame) -> DataFrame:
    """One row (name, type) per column, from the schema of the frame."""
    unknown = [f.name for f in df.schema if type(f.dataType) not in TYPE_NAMES]
    if unknown:
        raise TypeError(f"columns of unsupported type: {unknown}")
    rows = [(f.name, TYPE_NAMES[type(f.dataType)]) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "name string, type string")


def inferred_types(raw: DataFrame, text_columns: list[str] | None = None) -> DataFrame:
    """One row (name, type) per column of an uncleaned all-text extract, from its values.

    A column of whole numbers without gaps is INT64, any other number column FLOAT64. All columns
    are judged in one pass that shuffles a single row per task.
    """
    keep = TEXT_COLUMNS if text_columns is None else text_columns
    named = clean_names(raw)

    def kind(name: str):
        if name == "DATE_ID":
            return F.lit("DATE")
        if name in keep:
            return F.lit("STRING")
        text = F.col(name)
        whole = F.coalesce(text.rlike(WHOLE_NUMBER) & to_number(text).isNotNull(), F.lit(False))
        return F.when(F.bool_and(whole), "INT64").otherwise("FLOAT64")

    kinds = named.agg(*[kind(c).alias(c) for c in named.columns])
    return kinds.unpivot([], named.columns, "name", "type")

"""The charts of a report page, as data."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellkpi.functions.cells import CELL, SECTORS
from cellkpi.operators.axes import ALL_SECTORS

BAND_SERIES = "Band"
TOTAL_SERIES = "Total"
CELL_SERIES = CELL


class Chart(NamedTuple):
    item_id: int
    title: str
    kpi: str
    series_key: str
    sector: str
    agg: str
    shape: str
    y_min: float | None
    y_max: float | None


# The page's charts in order (title, counter, what a series is, aggregation, shape),
# and the value ranges of charts by the part of the title before the first hyphen.
SITE_CHARTS = [
    ("Payload - Site", "Total_Traffic_Volume", BAND_SERIES, "sum", "area"),
    ("Payload - Site", "Total_Traffic_Volume", TOTAL_SERIES, "sum", "line"),
]
SECTOR_CHARTS = [
    ("Payload", "Total_Traffic_Volume", BAND_SERIES, "sum", "area"),
    ("Payload", "Total_Traffic_Volume", BAND_SERIES, "sum", "line"),
    ("Payload", "Total_Traffic_Volume", CELL_SERIES, "sum", "line"),
    ("Payload", "Total_Traffic_Volume", CELL_SERIES, "sum", "area"),
    ("DL PRB", "DL_Resource_Block_Utilizing_Rate", CELL_SERIES, "mean", "line"),
    ("CQI", "Average_CQI_nonHOME", CELL_SERIES, "mean", "line"),
    ("SE", "SE_2", CELL_SERIES, "mean", "line"),
    ("Availability", "Radio_Network_Availability_Rate", CELL_SERIES, "mean", "line"),
    ("RRCSR", "RRC_Setup_Success_Rate_Service", CELL_SERIES, "mean", "line"),
    ("ERABSR", "ERAB_Setup_Success_Rate_All", CELL_SERIES, "mean", "line"),
    ("SSSR", "Session_Setup_Success_Rate", CELL_SERIES, "mean", "line"),
    ("SAR", "Session_Abnormal_Release", CELL_SERIES, "mean", "line"),
    ("INTRAFreq", "Intra_Frequency_Handover_Out_Success_Rate", CELL_SERIES, "mean", "line"),
    ("INTERFreq", "inter_freq_HO", CELL_SERIES, "mean", "line"),
    ("RSSI", "UL_RSSI_dbm", CELL_SERIES, "mean", "line"),
    ("UL PRB", "UL_Resource_Block_Utilizing_Rate", CELL_SERIES, "mean", "line"),
    ("DL_PDCP_User_Throughput", "DL_PDCP_User_Throughput", CELL_SERIES, "mean", "line"),
    (
        "User_Uplink_Average_Throughput",
        "User_Uplink_Average_Throughput",
        CELL_SERIES,
        "mean",
        "line",
    ),
    ("LTE_CSFB_SR", "LTE_CSFB_SR", CELL_SERIES, "mean", "line"),
]
Y_RANGES = {
    "Availability": (None, 100.0),
    "INTRAFreq": (None, 100.0),
    "INTERFreq": (None, 100.0),
    "LTE_CSFB_SR": (None, 100.0),
    "DL PRB": (None, 100.0),
    "SSSR": (90.0, 100.0),
    "RRCSR": (90.0, 100.0),
    "ERABSR": (90.0, 100.0),
}


def y_range(title: str) -> tuple[float | None, float | None]:
    prefix = title.partition("-")[0].strip()
    return Y_RANGES.get(prefix, (None, None))


def _page_charts() -> list[Chart]:
    rows = [(title, ALL_SECTORS, *rest) for title, *rest in SITE_CHARTS]
    rows += [(f"{title} - Sec {s}", s, *rest) for title, *rest in SECTOR_CHARTS for s in SECTORS]
    return [
        Chart(i, title, kpi, series_key, sector, agg, shape, *y_range(title))
        for i, (title, sector, kpi, series_key, agg, shape) in enumerate(rows, start=1)
    ]


CHARTS = _page_charts()
MEAN_KPIS = [kpi for _, kpi, _, agg, _ in SECTOR_CHARTS if agg == "mean"]

CHART_SCHEMA = pa.schema(
    [
        ("item_id", pa.int32()),
        ("title", pa.string()),
        ("kpi", pa.string()),
        ("series_key", pa.string()),
        ("sector", pa.string()),
        ("agg", pa.string()),
        ("shape", pa.string()),
        ("y_min", pa.float64()),
        ("y_max", pa.float64()),
    ]
)


def chart_frame(spark: SparkSession, charts: list[Chart] = CHARTS) -> DataFrame:
    """The charts as a frame, a local relation of one row per chart."""
    rows = [c._asdict() for c in charts]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=CHART_SCHEMA))

"""Spark jobs over cellular (4G) cell performance counters.

Ingest and clean daily and hourly extracts, derive the site, band and sector of
each cell, and roll the counters up into calendar-bucketed report series.
"""

from cellkpi.plans.catalog import CHARTS, Chart
from cellkpi.plans.export import export_rows, preview, write_csv
from cellkpi.plans.page import cached, page_rows
from cellkpi.plans.report import chart_axes, out_of_range, page_report, report, stacked_areas
from cellkpi.session import build_session
from cellkpi.sources.extracts import clean_extract, read_extract, with_cell_dimensions
from cellkpi.sources.tables import latest_date, read_facts, save_facts, write_facts
from cellkpi.streaming.append import append_facts, stream_extracts

__all__ = [
    "CHARTS",
    "Chart",
    "append_facts",
    "build_session",
    "cached",
    "chart_axes",
    "clean_extract",
    "export_rows",
    "latest_date",
    "out_of_range",
    "page_report",
    "page_rows",
    "preview",
    "read_extract",
    "read_facts",
    "report",
    "save_facts",
    "stacked_areas",
    "stream_extracts",
    "with_cell_dimensions",
    "write_csv",
    "write_facts",
]

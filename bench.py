"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads. Each query runs once to warm up and
then BENCH_RUNS times; the best time counts. ``facts_*`` queries read a fact table that the ingest
wrote, on a few days of many rows, the others the mapped test tables.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from cellkpi.operators import rollups
from cellkpi.plans.catalog import CHARTS, TOTAL_SERIES
from cellkpi.plans.page import page_rows
from cellkpi.plans.report import report
from cellkpi.registry.queries import END, SITE, START, queries, rows_for
from cellkpi.session import build_session, scratch_path
from cellkpi.sources.mapped import DECIMALS, busy_days
from cellkpi.sources.tables import latest_date, read_facts, write_facts

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINES = [
    "site_report_weekly",
    "report_daily",
    "report_weekly",
    "report_monthly",
    "report_hourly",
    "traffic_by_band_weekly",
    "kpi_mean_by_sector_cell_daily",
    "stacked_area",
    "coerced_numbers",
]


def one_job_per_chart(rows: DataFrame, period: str) -> None:
    """The page as one grouped query after another, the way a chart-by-chart page asks for it."""
    for chart in CHARTS:
        shown = rows if chart.sector == "All" else rows.where(f"Sector = '{chart.sector}'")
        by = [] if chart.series_key == TOTAL_SERIES else [chart.series_key]
        run(rollups.series(shown, period, by, {chart.kpi: chart.agg}, DECIMALS))


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(action, runs: int = RUNS, warm_up: bool = True) -> float:
    if warm_up:
        action()
    times = []
    for _ in range(runs):
        begin = time.perf_counter()
        action()
        times.append(time.perf_counter() - begin)
    return round(min(times), 3)


def main() -> None:
    settings = {
        "spark.master": f"local[{CPUS}]",
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
    }
    spark = build_session("bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    times = {name: best(lambda q=known[name]: run(q(spark, SF_DIR))) for name in HEADLINES}

    path = scratch_path(spark, "facts")
    write = best(lambda: write_facts(busy_days(spark, SF_DIR, "year"), path), runs=1, warm_up=False)
    facts = read_facts(spark, path)
    site = page_rows(facts, "daily", site=SITE, site_mode="exact", start=START, end=END)
    times["facts_site_report_weekly"] = best(lambda: run(report(site, "Weekly", decimals=DECIMALS)))
    everything = page_rows(facts, "daily")
    times["facts_report_monthly"] = best(
        lambda: run(report(everything, "Monthly", decimals=DECIMALS))
    )
    times["facts_latest_date"] = best(lambda: run(latest_date(facts)))

    monthly = rows_for(spark, SF_DIR, "Monthly")
    naive = best(lambda: one_job_per_chart(monthly, "Monthly"), runs=1, warm_up=False)
    result = {
        "metric": "sum of best times of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "other": {"write_facts": write, "monthly_one_job_per_chart": naive},
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

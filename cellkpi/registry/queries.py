"""Each query as a Spark job over the general test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellkpi.functions.values import to_date, to_number
from cellkpi.operators import rollups
from cellkpi.operators.filters import (
    dates_between,
    default_dates,
    in_bands,
    in_sector,
    site_contains,
    site_is,
)
from cellkpi.operators.measures import scale_measures, with_hour_timestamp
from cellkpi.plans.cache import PageCache
from cellkpi.plans.catalog import CHARTS, MEAN_KPIS
from cellkpi.plans.export import export_rows, preview, write_csv
from cellkpi.plans.page import cached, page_rows
from cellkpi.plans.partials import load_facts, report_from_partials
from cellkpi.plans.report import chart_axes, out_of_range, page_report, report, stacked_areas
from cellkpi.session import scratch_path
from cellkpi.sources.arrow_files import read_arrow, write_arrow
from cellkpi.sources.cell_index import read_matching, write_indexed_facts
from cellkpi.sources.extracts import (
    CSV_DIALECT,
    clean_extract,
    coercions,
    csv_options,
    observe_coercions,
    read_extract,
    read_extract_rows,
    split_rows,
    with_cell_dimensions,
)
from cellkpi.sources.mapped import (
    DECIMALS,
    busy_days,
    cell_daily,
    cell_hourly,
    damaged_daily_text,
    missing_sectors,
    odd_cells,
    quoted_text,
    raw_daily_text,
    whole_daily,
)
from cellkpi.sources.published import publish_facts, save_bucketed
from cellkpi.sources.schema import clean_names, inferred_types
from cellkpi.sources.tables import latest_date, latest_loaded_date, read_facts, write_facts
from cellkpi.streaming.append import append_facts, stream_extracts

Query = Callable[[SparkSession, str], DataFrame]

SITE = "saa007"
START, END = "1996-01-01", "1997-12-31"
FACTS = {"Daily": cell_daily, "Weekly": cell_daily, "Monthly": cell_daily, "Hourly": cell_hourly}
GRAIN = {"Daily": "daily", "Weekly": "daily", "Monthly": "daily", "Hourly": "hourly"}

VALUES = ["EUTRANCELLFDD", "DATE_ID", "Total_Traffic_Volume", "SE_2"]


def rows_for(spark: SparkSession, sf_dir: str, period: str, **scope) -> DataFrame:
    return page_rows(FACTS[period](spark, sf_dir), GRAIN[period], **scope)


def _for_periods(name: str, build: Callable[[DataFrame, str], DataFrame]) -> dict[str, Query]:
    def query(period: str) -> Query:
        return lambda spark, sf_dir: build(rows_for(spark, sf_dir, period), period)

    return {f"{name}_{period.lower()}": query(period) for period in FACTS}


def _cell_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cell_dimensions(cell_daily(spark, sf_dir)).select(
        "EUTRANCELLFDD", "DATE_ID", "SiteID", "Band", "Sector", "NEID"
    )


def _scaled(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    facts = cell_daily(spark, sf_dir) if grain == "daily" else cell_hourly(spark, sf_dir)
    return scale_measures(facts, grain).select(
        "EUTRANCELLFDD",
        "DATE_ID",
        "Downlink_Traffic_Volume",
        "Uplink_Traffic_Volume",
        "Total_Traffic_Volume",
        "LTE_CSFB_SR",
    )


def _hour_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hour_timestamp(cell_hourly(spark, sf_dir)).select(VALUES)


def _coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = clean_names(raw_daily_text(spark, sf_dir))
    text = F.col("Total_Traffic_Volume")
    return named.select("EUTRANCELLFDD", text.alias("raw"), to_number(text).alias("number"))


def _parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = clean_names(raw_daily_text(spark, sf_dir))
    text = F.col("DATE_ID")
    broken = F.when(F.col("pm_count") == "7", F.concat(F.lit("x"), text)).otherwise(text)
    return named.select(
        "EUTRANCELLFDD",
        to_date(text).alias("day"),
        to_date(F.date_format(to_date(text), "dd/MM/yyyy"), "dd/MM/yyyy").alias("formatted_day"),
        to_date(broken, strict=False).alias("lenient_day"),
    )


def _traffic_report(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    traffic = [c for c in CHARTS if c.kpi == rollups.TRAFFIC]
    rows = rows_for(spark, sf_dir, period)
    return report(rows, period, charts=traffic, decimals=DECIMALS)


def _first_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_axes(rows_for(spark, sf_dir, "Weekly"), "Weekly")


def _stored(spark: SparkSession, sf_dir: str, load: Callable[[DataFrame, str], None]) -> DataFrame:
    path = scratch_path(spark, "facts")
    load(cell_hourly(spark, sf_dir), path)
    return read_facts(spark, path).drop("SiteKey")


def _write_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    def load(facts: DataFrame, path: str) -> None:
        write_facts(facts.where("HOUR_ID < 12"), path)
        write_facts(facts, path, "replace")

    return _stored(spark, sf_dir, load)


def _write_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    def load(facts: DataFrame, path: str) -> None:
        write_facts(facts, path)
        write_facts(facts, path, "append")

    return _stored(spark, sf_dir, load)


RELOAD_FROM = "2024-01-10"
YEARS_LATER = 27


def _write_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    def load(facts: DataFrame, path: str) -> None:
        write_facts(facts, path)
        changed = dates_between(facts, RELOAD_FROM).withColumn("SE_2", F.col("SE_2") + 1)
        write_facts(changed, path, "reload")

    return _stored(spark, sf_dir, load)


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "extract")
    raw_daily_text(spark, sf_dir).write.options(**CSV_DIALECT).csv(path)
    return clean_extract(read_extract(spark, path))


def _quoted_round_trip(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    path = scratch_path(spark, "extract")
    quoted_text(spark, sf_dir).write.options(**CSV_DIALECT).csv(path)
    return clean_extract(read_extract(spark, path, multi_line=True), **options)


def _quoted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export")
    rows = page_rows(clean_extract(quoted_text(spark, sf_dir)), "daily")
    write_csv(rows, path)
    return spark.read.schema(export_rows(rows).schema).options(**csv_options(True)).csv(path)


def _csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export")
    rows = rows_for(spark, sf_dir, "Daily")
    write_csv(rows, path)
    return spark.read.schema(export_rows(rows).schema).options(**csv_options()).csv(path)


def _stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "facts")
    write_facts(cell_hourly(spark, sf_dir), path)
    return page_report(read_facts(spark, path), "hourly", "Hourly", decimals=DECIMALS)


def _stored_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "facts")
    write_facts(busy_days(spark, sf_dir), path)
    return read_facts(spark, path)


def _indexed_odd(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    path = scratch_path(spark, "indexed")
    write_indexed_facts(odd_cells(spark, sf_dir, "year"), path, groups=16)
    return read_matching(spark, path, text).select(VALUES)


def _from_partials(spark: SparkSession, sf_dir: str, period: str, reload: bool) -> DataFrame:
    """A report from partials of a load, and of a second load of some of its days."""
    facts_path, path = scratch_path(spark, "facts"), scratch_path(spark, "partials")
    facts = busy_days(spark, sf_dir)
    load_facts(facts, facts_path, path, "replace", decimals=DECIMALS)
    if reload:
        changed = dates_between(facts, START, END).withColumn("SE_2", F.col("SE_2") + 1)
        load_facts(changed, facts_path, path, "reload", decimals=DECIMALS)
    return report_from_partials(read_facts(spark, path), period, decimals=DECIMALS)


def _keyed_pages(spark: SparkSession, sf_dir: str, reload: bool) -> DataFrame:
    """Two pages of one site: other bands and another period are a hit, reloaded days a miss."""
    path, folder = scratch_path(spark, "facts"), scratch_path(spark, "pages")
    facts = busy_days(spark, sf_dir)
    write_facts(facts, path)
    scope = {"site": SITE, "start": START, "end": END}
    PageCache(spark, folder).rows(path, "daily", **scope)
    if reload:
        changed = dates_between(facts, START, END).withColumn("SE_2", F.col("SE_2") + 1)
        write_facts(changed, path, "reload")
    cache = PageCache(spark, folder)
    rows = cache.rows(path, "daily", bands=["L1800", "L900"], **scope)
    if (cache.hits, cache.misses) != ((0, 1) if reload else (1, 0)):
        raise RuntimeError(f"{cache.hits} hits and {cache.misses} misses")
    return report(rows, "Weekly", decimals=DECIMALS)


def _latest_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "facts")
    write_facts(busy_days(spark, sf_dir, "year"), path)
    return latest_loaded_date(spark, path)


def _arrow_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "arrow")
    write_arrow(cell_hourly(spark, sf_dir), path)
    return read_arrow(spark, path)


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts behind a view after a replace; the first version holds half of the rows."""
    name, root = f"facts_{uuid.uuid4().hex}", scratch_path(spark, "published")
    facts = busy_days(spark, sf_dir, "year")
    publish_facts(facts.where("SE_2 > 0.02"), name, root)
    publish_facts(facts, name, root)
    return spark.table(name).drop("SiteKey")


def _bucketed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"bucketed_{uuid.uuid4().hex}"
    save_bucketed(busy_days(spark, sf_dir, "year"), table, 8)
    rows = page_rows(spark.table(table), "daily")
    return rollups.means_by_sector_cell(rows, "Monthly", MEAN_KPIS, DECIMALS)


def _damaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts and rejected rows of an extract some of whose rows are too wide, or have no date."""
    path = scratch_path(spark, "extract")
    rows = damaged_daily_text(spark, sf_dir)
    # Whole lines as one column, so that a comma within a value makes one more field.
    line = F.concat_ws(",", *(f"`{c}`" for c in rows.columns)).alias(",".join(rows.columns))
    rows.select(line).write.options(header=True, sep="\u0001").csv(path)
    return split_rows(read_extract_rows(spark, path))


def _coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    observation = Observation()
    raw = observe_coercions(raw_daily_text(spark, sf_dir), observation)
    clean_extract(raw).write.parquet(scratch_path(spark, "facts"))
    return coercions(spark, observation)


def _default_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily facts of years around today, of which the default range leaves the first and last out."""
    facts = cell_daily(spark, sf_dir)
    moved = facts.withColumn("DATE_ID", F.add_months("DATE_ID", 12 * YEARS_LATER))
    return dates_between(moved, *default_dates("daily")).select(VALUES)


def _default_dates_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = cell_hourly(spark, sf_dir)
    apart = F.datediff("DATE_ID", F.lit(RELOAD_FROM).cast("date"))
    moved = facts.withColumn("DATE_ID", F.date_add(F.current_date(), apart))
    return dates_between(moved, *default_dates("hourly")).select(VALUES)


def _cached_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of three periods over one kept selection, written before it is released."""
    path = scratch_path(spark, "pages")
    with cached(rows_for(spark, sf_dir, "Daily", site=SITE, start=START, end=END)) as rows:
        for period in ("Daily", "Weekly", "Monthly"):
            page = report(rows, period, decimals=DECIMALS)
            page.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _hour_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = cell_hourly(spark, sf_dir)
    late = facts.withColumn("HOUR_ID", F.col("HOUR_ID") + F.col("SE_2").cast("int"))
    return with_hour_timestamp(late).select(VALUES)


def _untimed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = cell_hourly(spark, sf_dir)
    lost = facts.withColumn("HOUR_ID", F.nullif("HOUR_ID", F.lit(23)))
    return rollups.untimed_rows(page_rows(lost, "hourly"))


def _stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracts = scratch_path(spark, "arrivals")
    path, checkpoint = scratch_path(spark, "facts"), scratch_path(spark, "checkpoint")
    raw = cell_hourly(spark, sf_dir)
    for arrived in (raw.where("HOUR_ID < 12"), raw.where("HOUR_ID >= 12")):
        arrived.write.mode("append").options(**CSV_DIALECT).csv(extracts)
        facts = clean_extract(stream_extracts(spark, extracts))
        append_facts(facts, path, checkpoint).awaitTermination()
    return read_facts(spark, path).drop("SiteKey")


def queries() -> dict[str, Query]:
    return {
        "latest_date": lambda s, d: latest_date(cell_daily(s, d)),
        "latest_date_hourly": lambda s, d: latest_date(cell_hourly(s, d)),
        "cell_dims": _cell_dims,
        "site_date_filter": lambda s, d: dates_between(
            site_contains(cell_daily(s, d), SITE), START, END
        ).select(VALUES),
        "site_exact_filter": lambda s, d: dates_between(
            site_is(cell_daily(s, d), SITE), START, END
        ).select(VALUES),
        "band_filter": lambda s, d: in_bands(cell_daily(s, d), ["L1800", "L2300"]).select(VALUES),
        "sector_filter": lambda s, d: in_sector(cell_daily(s, d), "2").select(VALUES),
        "scaled_measures": lambda s, d: _scaled(s, d, "daily"),
        "scaled_measures_hourly": lambda s, d: _scaled(s, d, "hourly"),
        "hour_timestamp": _hour_timestamp,
        "sanitised_names": lambda s, d: clean_names(raw_daily_text(s, d)),
        "coerced_numbers": _coerced,
        "parsed_dates": _parsed_dates,
        "schema_report": lambda s, d: inferred_types(raw_daily_text(s, d)),
        **_for_periods(
            "traffic_by_band", lambda rows, p: rollups.traffic_by_band(rows, p, DECIMALS)
        ),
        **_for_periods("traffic_total", lambda rows, p: rollups.traffic_total(rows, p, DECIMALS)),
        **_for_periods(
            "traffic_by_sector_band",
            lambda rows, p: rollups.traffic_by_sector_band(rows, p, DECIMALS),
        ),
        **_for_periods(
            "traffic_by_sector_cell",
            lambda rows, p: rollups.traffic_by_sector_cell(rows, p, DECIMALS),
        ),
        **_for_periods(
            "kpi_mean_by_sector_cell",
            lambda rows, p: rollups.means_by_sector_cell(rows, p, MEAN_KPIS, DECIMALS),
        ),
        **_for_periods("report", lambda rows, p: report(rows, p, decimals=DECIMALS)),
        "all_sites_traffic_weekly": lambda s, d: _traffic_report(s, d, "Weekly"),
        "all_sites_traffic_monthly": lambda s, d: _traffic_report(s, d, "Monthly"),
        "site_report_weekly": lambda s, d: report(
            rows_for(s, d, "Weekly", site=SITE, start=START, end=END), "Weekly", decimals=DECIMALS
        ),
        "site_report_monthly_exact": lambda s, d: report(
            rows_for(s, d, "Monthly", site=SITE, site_mode="exact", bands=["L1800", "L900"]),
            "Monthly",
            decimals=DECIMALS,
        ),
        "report_hourly_stored": _stored_report,
        "untimed_rows": _untimed_rows,
        "first_bucket": _first_bucket,
        "stacked_area": lambda s, d: stacked_areas(
            rows_for(s, d, "Weekly"), "Weekly", decimals=DECIMALS
        ),
        "stacked_area_hourly": lambda s, d: stacked_areas(
            rows_for(s, d, "Hourly"), "Hourly", decimals=DECIMALS
        ),
        "stacked_area_spread": lambda s, d: stacked_areas(
            rows_for(s, d, "Weekly"), "Weekly", decimals=DECIMALS, parts=16
        ),
        "out_of_range": lambda s, d: out_of_range(
            rows_for(s, d, "Weekly"), "Weekly", decimals=DECIMALS
        ),
        "export_rows": lambda s, d: export_rows(rows_for(s, d, "Daily")),
        "export_rows_hourly": lambda s, d: export_rows(rows_for(s, d, "Hourly")),
        "preview_rows": lambda s, d: preview(rows_for(s, d, "Daily"), 5),
        "write_overwrite": _write_overwrite,
        "write_append": _write_append,
        "write_reload": _write_reload,
        "csv_round_trip": _csv_round_trip,
        "csv_export": _csv_export,
        "stream_append": _stream_append,
        "csv_quoted_round_trip": lambda s, d: _quoted_round_trip(s, d, missing_texts=[]),
        "extract_missing_texts": _quoted_round_trip,
        "csv_export_quoted": _quoted_export,
        "report_monthly_default": lambda s, d: report(
            page_rows(whole_daily(s, d), "daily"), "Monthly"
        ),
        "kpi_mean_by_sector_cell_weekly_default": lambda s, d: rollups.means_by_sector_cell(
            page_rows(whole_daily(s, d), "daily"), "Weekly", MEAN_KPIS
        ),
        "report_monthly_missing_sectors": lambda s, d: report(
            page_rows(missing_sectors(s, d), "daily"), "Monthly", decimals=DECIMALS
        ),
        "cell_dims_all_codes": lambda s, d: with_cell_dimensions(odd_cells(s, d)).select(
            "EUTRANCELLFDD", "DATE_ID", "SiteID", "Band", "Sector", "NEID"
        ),
        "site_contains_wildcard": lambda s, d: site_contains(odd_cells(s, d), "s__00_").select(
            VALUES
        ),
        "site_contains_inner": lambda s, d: site_contains(odd_cells(s, d), SITE).select(VALUES),
        "site_contains_stored": lambda s, d: _indexed_odd(s, d, SITE),
        "site_contains_wildcard_stored": lambda s, d: _indexed_odd(s, d, "s_a007"),
        "site_exact_odd_cells": lambda s, d: site_is(odd_cells(s, d), SITE).select(VALUES),
        "complement_nulls": lambda s, d: scale_measures(odd_cells(s, d), "daily").select(
            "EUTRANCELLFDD", "DATE_ID", "Total_Traffic_Volume", "LTE_CSFB_SR"
        ),
        "hour_rollover": _hour_rollover,
        "default_dates": _default_dates,
        "default_dates_hourly": _default_dates_hourly,
        "arrow_round_trip": _arrow_round_trip,
        "write_published": _published,
        "kpi_mean_by_sector_cell_bucketed": _bucketed_means,
        "extract_good_rows": lambda s, d: _damaged(s, d)[0],
        "extract_rejected_rows": lambda s, d: _damaged(s, d)[1].drop("file"),
        "coercion_report": _coercions,
        "empty_reversed_range": lambda s, d: report(
            rows_for(s, d, "Weekly", start=END, end=START), "Weekly", decimals=DECIMALS
        ),
        "empty_unknown_site": lambda s, d: report(
            rows_for(s, d, "Weekly", site="zzz999"), "Weekly", decimals=DECIMALS
        ),
        "report_weekly_stored_daily": lambda s, d: page_report(
            _stored_daily(s, d), "daily", "Weekly", decimals=DECIMALS
        ),
        "latest_date_stored": lambda s, d: latest_date(_stored_daily(s, d)),
        "latest_date_loaded": _latest_loaded,
        "cached_page_three_periods": _cached_page,
        "cached_page_hit": lambda s, d: _keyed_pages(s, d, False),
        "cached_page_reloaded": lambda s, d: _keyed_pages(s, d, True),
        "report_weekly_partials": lambda s, d: _from_partials(s, d, "Weekly", False),
        "report_monthly_partials_reloaded": lambda s, d: _from_partials(s, d, "Monthly", True),
        "empty_selection": lambda s, d: report(
            rows_for(s, d, "Weekly", bands=[]), "Weekly", decimals=DECIMALS
        ),
    }

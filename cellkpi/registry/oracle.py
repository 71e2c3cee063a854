"""The checked queries as SQL for another engine, written chart by chart over the raw rows.

Sums are taken over decimals with six places, which the test tables' counters fit, so that both
engines have one right answer to the last bit.
"""

from __future__ import annotations

from cellkpi.plans.catalog import CHARTS, MEAN_KPIS, TOTAL_SERIES, Chart
from cellkpi.registry.queries import END, RELOAD_FROM, SITE, START, YEARS_LATER

DAILY = """
SELECT l_returnflag AS AREA, CAST(l_shipdate AS DATE) AS DATE_ID, site AS ERBS,
  site || CASE l_linenumber WHEN 1 THEN 'ML' WHEN 2 THEN 'MR' WHEN 3 THEN 'ME' WHEN 4 THEN 'MT'
    WHEN 5 THEN 'MM' WHEN 6 THEN 'VE' WHEN 7 THEN 'ZZ' END
    || CAST(l_partkey % 8 AS VARCHAR) AS EUTRANCELLFDD,
  l_extendedprice AS Total_Traffic_Volume, l_quantity * 100 AS Downlink_Traffic_Volume,
  l_quantity * 10 AS Uplink_Traffic_Volume,
  NULLIF(l_quantity, 50) AS DL_Resource_Block_Utilizing_Rate,
  CAST(l_linenumber AS DOUBLE) AS Average_CQI_nonHOME, l_tax AS SE_2,
  CAST(100 - l_linenumber AS DOUBLE) AS Radio_Network_Availability_Rate,
  CAST(85 + l_orderkey % 16 AS DOUBLE) AS RRC_Setup_Success_Rate_Service,
  CAST(85 + l_partkey % 16 AS DOUBLE) AS ERAB_Setup_Success_Rate_All,
  CAST(85 + (l_orderkey + l_partkey) % 16 AS DOUBLE) AS Session_Setup_Success_Rate,
  l_discount AS Session_Abnormal_Release,
  CAST(l_orderkey % 101 AS DOUBLE) AS Intra_Frequency_Handover_Out_Success_Rate,
  CAST(l_partkey % 101 AS DOUBLE) AS inter_freq_HO, 0 - l_quantity - 70 AS UL_RSSI_dbm,
  l_quantity + 1 AS UL_Resource_Block_Utilizing_Rate, l_extendedprice AS DL_PDCP_User_Throughput,
  NULLIF(l_quantity, 1) AS User_Uplink_Average_Throughput,
  CAST(l_orderkey % 101 AS DOUBLE) AS LTE_CSFB_SR
FROM (SELECT *, 'SAA' || LPAD(CAST(l_suppkey % 20 AS VARCHAR), 3, '0') AS site FROM lineitem)
"""

HOURLY = """
SELECT CAST(ts AS DATE) AS DATE_ID, CAST(EXTRACT(HOUR FROM ts) AS INTEGER) AS HOUR_ID,
  site AS ERBS,
  site || CASE event_type WHEN 'click' THEN 'ML' WHEN 'purchase' THEN 'MR' WHEN 'view' THEN 'ME'
    WHEN 'signup' THEN 'MT' WHEN 'error' THEN 'MM' END
    || CAST(event_id % 8 AS VARCHAR) AS EUTRANCELLFDD,
  value AS Total_Traffic_Volume, value * 100 AS Downlink_Traffic_Volume,
  value * 10 AS Uplink_Traffic_Volume, NULLIF(k, 50) AS DL_Resource_Block_Utilizing_Rate,
  CAST(user_id % 16 AS DOUBLE) AS Average_CQI_nonHOME, CAST(event_id % 7 AS DOUBLE) AS SE_2,
  CAST(100 - event_id % 5 AS DOUBLE) AS Radio_Network_Availability_Rate,
  CAST(85 + user_id % 16 AS DOUBLE) AS RRC_Setup_Success_Rate_Service,
  CAST(85 + event_id % 16 AS DOUBLE) AS ERAB_Setup_Success_Rate_All,
  CAST(85 + (user_id + event_id) % 16 AS DOUBLE) AS Session_Setup_Success_Rate,
  CAST(event_id % 3 AS DOUBLE) AS Session_Abnormal_Release,
  CAST(event_id % 101 AS DOUBLE) AS Intra_Frequency_Handover_Out_Success_Rate,
  CAST(user_id % 101 AS DOUBLE) AS inter_freq_HO, 0 - k - 70 AS UL_RSSI_dbm,
  k + 1 AS UL_Resource_Block_Utilizing_Rate, value AS DL_PDCP_User_Throughput,
  NULLIF(k, 1) AS User_Uplink_Average_Throughput, k AS LTE_CSFB_SR
FROM (SELECT *, 'SAA' || LPAD(CAST(user_id % 20 AS VARCHAR), 3, '0') AS site,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
"""

RAW_DAILY = """
SELECT l_returnflag AS AREA, strftime(l_shipdate, '%Y-%m-%d') AS DATE_ID, site AS ERBS,
  site || CASE l_linenumber WHEN 1 THEN 'ML' WHEN 2 THEN 'MR' WHEN 3 THEN 'ME' WHEN 4 THEN 'MT'
    WHEN 5 THEN 'MM' WHEN 6 THEN 'VE' WHEN 7 THEN 'ZZ' END
    || CAST(l_partkey % 8 AS VARCHAR) AS EUTRANCELLFDD,
  CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '#DIV/0!'
    ELSE CAST(l_quantity AS VARCHAR) END AS Total_Traffic_Volume,
  CAST(l_linenumber AS VARCHAR) AS pm_count, CAST(l_tax AS VARCHAR) AS SE_2,
  CAST(85 + l_orderkey % 16 AS VARCHAR) AS RRC_Setup_Success_Rate_Service,
  CAST(l_orderkey % 101 AS VARCHAR) AS Intra_Frequency_Handover_Out_Success_Rate
FROM (SELECT *, 'SAA' || LPAD(CAST(l_suppkey % 20 AS VARCHAR), 3, '0') AS site FROM lineitem)
"""

CLEANED = f"""SELECT * REPLACE (CAST(DATE_ID AS DATE) AS DATE_ID,
            TRY_CAST(Total_Traffic_Volume AS DOUBLE) AS Total_Traffic_Volume,
            CAST(pm_count AS DOUBLE) AS pm_count, CAST(SE_2 AS DOUBLE) AS SE_2,
            CAST(RRC_Setup_Success_Rate_Service AS DOUBLE) AS RRC_Setup_Success_Rate_Service,
            CAST(Intra_Frequency_Handover_Out_Success_Rate AS DOUBLE)
              AS Intra_Frequency_Handover_Out_Success_Rate) FROM ({RAW_DAILY})"""

# Band codes and sector digits of the cell naming scheme.
BAND_TABLE = {
    "L1800": "AL EL IL ML SL",
    "L2100": "ER HR IR MR",
    "L2300": "ME MF IE IF MV VE VF",
    "L900": "MT ST",
}
SECTOR_TABLE = {"1": "1 4", "2": "2 5", "3": "3 6"}


def _looked_up(key: str, table: dict[str, str]) -> str:
    """A scalar query that finds the name of a code in a table of (code, name) rows."""
    rows = ", ".join(f"('{c}', '{name}')" for name, codes in table.items() for c in codes.split())
    return f"""COALESCE((SELECT MAX(coded.name) FROM (VALUES {rows}) AS coded(code, name)
      WHERE coded.code = {key}), 'Not Define')"""


BAND = _looked_up("SUBSTR(EUTRANCELLFDD, 7, 2)", BAND_TABLE)
SECTOR = _looked_up("RIGHT(EUTRANCELLFDD, 1)", SECTOR_TABLE)
ELEMENT = f"""CASE ({BAND})
  WHEN 'L1800' THEN LEFT(EUTRANCELLFDD, 6) || 'ML1'
  WHEN 'L2100' THEN LEFT(EUTRANCELLFDD, 6) || 'MR1'
  WHEN 'L2300' THEN LEFT(EUTRANCELLFDD, 6) || 'ME1'
  WHEN 'L900' THEN LEFT(EUTRANCELLFDD, 6) || 'MT1'
  ELSE CASE WHEN SUBSTR(EUTRANCELLFDD, 7, 2) = 'MM' THEN LEFT(EUTRANCELLFDD, 6) || 'MT1'
    ELSE 'Not Define' END END"""
DIMENSIONS = f"""LEFT(EUTRANCELLFDD, 6) AS SiteID, {BAND} AS Band, {SECTOR} AS Sector,
  {ELEMENT} AS NEID"""

HOUR_TIMESTAMP = "CAST(DATE_ID AS TIMESTAMP) + HOUR_ID * INTERVAL 1 HOUR"
BUCKETS = {
    "Daily": "DATE_ID",
    "Weekly": "CAST(DATE_TRUNC('week', DATE_ID) AS DATE)",
    "Monthly": "CAST(DATE_TRUNC('month', DATE_ID) AS DATE)",
    "Hourly": "DATE_TRUNC('hour', DATE_ID)",
}
PERIODS = list(BUCKETS)

CONTAINS = f"LOWER(EUTRANCELLFDD) LIKE '%{SITE}%'"
EXACT = f"LOWER(LEFT(EUTRANCELLFDD, 6)) = '{SITE}'"
RANGE = f"DATE_ID BETWEEN DATE '{START}' AND DATE '{END}'"
REAL_BANDS = "('L1800', 'L2100', 'L2300', 'L900')"

DAILY_UNITS = """100 - LTE_CSFB_SR AS LTE_CSFB_SR,
  Downlink_Traffic_Volume / 1000 AS Downlink_Traffic_Volume,
  Uplink_Traffic_Volume / 1000 AS Uplink_Traffic_Volume,
  Total_Traffic_Volume / 1000 AS Total_Traffic_Volume"""


# Odd cells as in the Spark mapping, written out on their own.
ODD_CODES = "AL EL IL ML SL ER HR IR MR ME MF IE IF MV VE VF MT ST MM ZZ".split()
ODD = f"""
SELECT CASE WHEN l_partkey % 23 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN LEFT(cell, 4)
    WHEN l_partkey % 17 = 0 THEN LOWER(cell) WHEN l_partkey % 13 = 0 THEN 'X' || cell
    ELSE cell END AS EUTRANCELLFDD, CAST(l_shipdate AS DATE) AS DATE_ID,
  l_extendedprice AS Total_Traffic_Volume, l_tax AS SE_2,
  NULLIF(CAST(l_orderkey % 11 AS DOUBLE), 0) AS LTE_CSFB_SR
FROM (SELECT *, 'SAA' || LPAD(CAST(l_suppkey % 20 AS VARCHAR), 3, '0')
    || {ODD_CODES}[l_orderkey % 20 + 1] || CAST(l_partkey % 8 AS VARCHAR) AS cell FROM lineitem)
"""
YEAR = "CAST(DATE_TRUNC('year', DATE_ID) AS DATE)"
VOLUMES = ["Downlink_Traffic_Volume", "Uplink_Traffic_Volume", "Total_Traffic_Volume"]
WHOLE = f"""SELECT AREA, DATE_ID, ERBS, EUTRANCELLFDD,
  {", ".join(f"FLOOR({c}) * 1000 AS {c}" for c in VOLUMES)},
  FLOOR(COLUMNS(* EXCLUDE (AREA, DATE_ID, ERBS, EUTRANCELLFDD, {", ".join(VOLUMES)})))
FROM ({DAILY})"""
QUOTED = """SELECT CASE WHEN doc_id % 5 = 0 THEN 'NA'
    ELSE ' say "x", y: ' || text || CHR(10) || '"end" ' END AS AREA,
  DATE '2023-07-01' AS DATE_ID, source AS ERBS,
  'SAA007ML' || CAST(doc_id % 8 AS VARCHAR) AS EUTRANCELLFDD, CAST(doc_id AS DOUBLE) AS SE_2
FROM documents"""
BUSY = f"SELECT * REPLACE (CAST(DATE_TRUNC('month', DATE_ID) AS DATE) AS DATE_ID) FROM ({DAILY})"
RELOADED = f"""SELECT * REPLACE (CASE WHEN {RANGE} THEN SE_2 + 1 ELSE SE_2 END AS SE_2)
FROM ({BUSY})"""
MISSING_SECTOR = DIMENSIONS.replace(
    f"{SECTOR} AS Sector", f"CASE WHEN LTE_CSFB_SR % 7 <> 0 THEN {SECTOR} END AS Sector"
)


def page_rows(
    period: str,
    where: str = "TRUE",
    bands: str = REAL_BANDS,
    daily: str = DAILY,
    dimensions: str = DIMENSIONS,
) -> str:
    """Rows in page units with dimensions, at raw grain."""
    if period == "Hourly":
        units = f"100 - LTE_CSFB_SR AS LTE_CSFB_SR, {HOUR_TIMESTAMP} AS DATE_ID"
        shown, source = f"* EXCLUDE (HOUR_ID) REPLACE ({units})", HOURLY
    else:
        shown, source = f"* REPLACE ({DAILY_UNITS})", daily
    return f"""SELECT * FROM (SELECT {shown}, {dimensions} FROM ({source}) WHERE {where})
      WHERE Band IN {bands}"""


def bucketed(period: str, where: str = "TRUE", bands: str = REAL_BANDS, **source: str) -> str:
    return f"""SELECT *, LOWER(SiteID) AS site, {BUCKETS[period]} AS bucket
      FROM ({page_rows(period, where, bands, **source)})"""


def exact(agg: str, kpi: str) -> str:
    total = f"CAST(SUM(CAST({kpi} AS DECIMAL(18, 6))) AS DOUBLE)"
    return total if agg == "sum" else f"{total} / CAST(COUNT({kpi}) AS DOUBLE)"


def rollup(period: str, keys: str, values: str, where: str, **source: str) -> str:
    keys = ", ".join(k for k in ("site", "bucket", keys) if k)
    rows = bucketed(period, **source)
    return f"SELECT {keys}, {values} FROM ({rows}) WHERE {where} GROUP BY {keys}"


def _value(x: float | None) -> str:
    return "NULL" if x is None else str(x)


def _chart(chart: Chart, period: str) -> str:
    """One chart by its own grouping, as if it were asked for alone."""
    where = "TRUE" if chart.sector == "All" else f"Sector = '{chart.sector}'"
    if chart.series_key == TOTAL_SERIES:
        series, group = "'Total'", "site, bucket"
    else:
        series, group = chart.series_key, f"site, bucket, {chart.series_key}"
    value = exact(chart.agg, chart.kpi)
    low, high = _value(chart.y_min), _value(chart.y_max)
    return f"""SELECT '{period}' || ' Site ' || UPPER(site) AS page, site,
        {chart.item_id} AS item_id, '{chart.title}' AS title, '{chart.kpi}' AS kpi,
        '{chart.shape}' AS shape, '{chart.sector}' AS sector, {series} AS series, bucket,
        {value} AS value, CAST({low} AS DOUBLE) AS y_min, CAST({high} AS DOUBLE) AS y_max,
        COALESCE({value} < {low}, FALSE) OR COALESCE({value} > {high}, FALSE) AS out_of_range
      FROM rows WHERE {where} GROUP BY {group}"""


def report(
    period: str,
    charts: list[Chart] = CHARTS,
    where: str = "TRUE",
    bands: str = REAL_BANDS,
    **source: str,
) -> str:
    union = "\nUNION ALL\n".join(_chart(c, period) for c in charts)
    rows = bucketed(period, where, bands, **source)
    return f"WITH rows AS MATERIALIZED ({rows}), charts AS ({union}) SELECT * FROM charts"


def stacked(period: str) -> str:
    areas = report(period, [c for c in CHARTS if c.shape == "area"])
    return f"""SELECT *, CAST(SUM(CAST(COALESCE(value, 0) AS DECIMAL(18, 6)))
        OVER (PARTITION BY site, item_id, bucket ORDER BY series ROWS UNBOUNDED PRECEDING)
        AS DOUBLE) AS stack_top FROM ({areas})"""


def first_buckets(period: str) -> str:
    parts = [
        f"""SELECT site, {c.item_id} AS item_id, '{c.title}' AS title, '{c.sector}' AS sector,
          MIN(bucket) AS first_bucket, CAST({_value(c.y_min)} AS DOUBLE) AS y_min,
          CAST({_value(c.y_max)} AS DOUBLE) AS y_max
        FROM rows WHERE {"TRUE" if c.sector == "All" else f"Sector = '{c.sector}'"} GROUP BY site"""
        for c in CHARTS
    ]
    return f"WITH rows AS MATERIALIZED ({bucketed(period)}) " + "\nUNION ALL\n".join(parts)


def _types() -> str:
    kinds = {"AREA": "STRING", "DATE_ID": "DATE", "ERBS": "STRING", "EUTRANCELLFDD": "STRING"}
    columns = [*kinds, "Total_Traffic_Volume", "pm_count", "SE_2"]
    columns += ["RRC_Setup_Success_Rate_Service", "Intra_Frequency_Handover_Out_Success_Rate"]
    whole = "COALESCE(regexp_full_match({0}, '[+-]?[0-9]+'), FALSE)"
    parts = []
    for c in columns:
        inferred = f"CASE WHEN BOOL_AND({whole.format(c)}) THEN 'INT64' ELSE 'FLOAT64' END"
        kind = f"'{kinds[c]}'" if c in kinds else inferred
        parts.append(f"SELECT '{c}' AS name, {kind} AS type FROM ({RAW_DAILY}) HAVING COUNT(*) > 0")
    return "\nUNION ALL\n".join(parts)


def _coerced() -> str:
    columns = ["Total_Traffic_Volume", "pm_count", "SE_2", "RRC_Setup_Success_Rate_Service"]
    lost = "{0} IS NOT NULL AND TRY_CAST({0} AS DOUBLE) IS NULL"
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", COUNT(*) FILTER ({lost.format(c)}) AS coerced,
          MIN({c}) FILTER ({lost.format(c)}) AS example FROM ({RAW_DAILY})"""
        for c in [*columns, "Intra_Frequency_Handover_Out_Success_Rate"]
    )


def oracle_sql() -> dict[str, str]:
    values = "EUTRANCELLFDD, DATE_ID, Total_Traffic_Volume, SE_2"
    volumes = "Downlink_Traffic_Volume, Uplink_Traffic_Volume, Total_Traffic_Volume"
    traffic = f"{exact('sum', 'Total_Traffic_Volume')} AS Total_Traffic_Volume"
    means = ", ".join(f"{exact('mean', k)} AS {k}" for k in MEAN_KPIS)
    in_sector = "Sector IN ('1', '2', '3')"
    traffic_charts = [c for c in CHARTS if c.kpi == "Total_Traffic_Volume"]
    ranged = [c for c in CHARTS if c.y_max is not None]
    stored = f"SELECT *, {DIMENSIONS} FROM ({HOURLY})"

    sql = {
        "latest_date": f"SELECT MAX(DATE_ID) AS most_recent_date FROM ({DAILY})",
        "latest_date_hourly": f"SELECT MAX(DATE_ID) AS most_recent_date FROM ({HOURLY})",
        "cell_dims": f"SELECT EUTRANCELLFDD, DATE_ID, {DIMENSIONS} FROM ({DAILY})",
        "site_date_filter": f"SELECT {values} FROM ({DAILY}) WHERE {CONTAINS} AND {RANGE}",
        "site_exact_filter": f"SELECT {values} FROM ({DAILY}) WHERE {EXACT} AND {RANGE}",
        "band_filter": f"SELECT {values} FROM ({DAILY}) WHERE {BAND} IN ('L1800', 'L2300')",
        "sector_filter": f"SELECT {values} FROM ({DAILY}) WHERE {SECTOR} = '2'",
        "scaled_measures": f"SELECT EUTRANCELLFDD, DATE_ID, {DAILY_UNITS} FROM ({DAILY})",
        "scaled_measures_hourly": f"""SELECT EUTRANCELLFDD, DATE_ID, {volumes},
            100 - LTE_CSFB_SR AS LTE_CSFB_SR FROM ({HOURLY})""",
        "hour_timestamp": f"""SELECT EUTRANCELLFDD, {HOUR_TIMESTAMP} AS DATE_ID,
            Total_Traffic_Volume, SE_2 FROM ({HOURLY})""",
        "sanitised_names": RAW_DAILY,
        "coerced_numbers": f"""SELECT EUTRANCELLFDD, Total_Traffic_Volume AS raw,
            TRY_CAST(Total_Traffic_Volume AS DOUBLE) AS number FROM ({RAW_DAILY})""",
        "parsed_dates": f"""SELECT EUTRANCELLFDD, CAST(DATE_ID AS DATE) AS day,
            CAST(DATE_ID AS DATE) AS formatted_day, TRY_CAST(
              CASE WHEN pm_count = '7' THEN 'x' || DATE_ID ELSE DATE_ID END AS DATE) AS lenient_day
            FROM ({RAW_DAILY})""",
        "schema_report": _types(),
        "all_sites_traffic_weekly": report("Weekly", traffic_charts),
        "all_sites_traffic_monthly": report("Monthly", traffic_charts),
        "site_report_weekly": report("Weekly", where=f"{CONTAINS} AND {RANGE}"),
        "site_report_monthly_exact": report("Monthly", where=EXACT, bands="('L1800', 'L900')"),
        "report_hourly_stored": report("Hourly"),
        "untimed_rows": f"""SELECT LOWER(LEFT(EUTRANCELLFDD, 6)) AS site, COUNT(*) AS rows
            FROM ({HOURLY}) WHERE HOUR_ID = 23 AND {BAND} IN {REAL_BANDS} GROUP BY 1""",
        "first_bucket": first_buckets("Weekly"),
        "stacked_area": stacked("Weekly"),
        "stacked_area_hourly": stacked("Hourly"),
        "stacked_area_spread": stacked("Weekly"),
        "out_of_range": f"SELECT * FROM ({report('Weekly', ranged)}) WHERE out_of_range",
        "export_rows": page_rows("Daily"),
        "export_rows_hourly": page_rows("Hourly"),
        "preview_rows": f"""SELECT * FROM ({page_rows("Daily")})
            ORDER BY DATE_ID NULLS FIRST, EUTRANCELLFDD NULLS FIRST, COLUMNS(
              * EXCLUDE (DATE_ID, EUTRANCELLFDD)) NULLS FIRST LIMIT 5""",
        "write_overwrite": stored,
        "write_append": f"{stored} UNION ALL {stored}",
        "write_reload": f"""SELECT * REPLACE (CASE WHEN DATE_ID >= DATE '{RELOAD_FROM}'
            THEN SE_2 + 1 ELSE SE_2 END AS SE_2) FROM ({stored})""",
        "csv_round_trip": CLEANED,
        "csv_export": page_rows("Daily"),
        "stream_append": stored,
        "csv_quoted_round_trip": QUOTED,
        "extract_missing_texts": f"SELECT * REPLACE (NULLIF(AREA, 'NA') AS AREA) FROM ({QUOTED})",
        "csv_export_quoted": f"""SELECT * REPLACE (NULLIF(AREA, 'NA') AS AREA), {DIMENSIONS}
            FROM ({QUOTED})""",
        "report_monthly_default": report("Monthly", daily=WHOLE),
        "kpi_mean_by_sector_cell_weekly_default": rollup(
            "Weekly", "Sector, EUTRANCELLFDD", means, in_sector, daily=WHOLE
        ),
        "report_monthly_missing_sectors": report("Monthly", dimensions=MISSING_SECTOR),
        "cell_dims_all_codes": f"SELECT EUTRANCELLFDD, DATE_ID, {DIMENSIONS} FROM ({ODD})",
        "site_contains_wildcard": f"""SELECT {values} FROM ({ODD})
            WHERE regexp_matches(LOWER(EUTRANCELLFDD), 's..00.')""",
        "site_contains_inner": f"SELECT {values} FROM ({ODD}) WHERE {CONTAINS}",
        "site_contains_stored": f"""SELECT * REPLACE ({YEAR} AS DATE_ID)
            FROM (SELECT {values} FROM ({ODD}) WHERE {CONTAINS})""",
        "site_contains_wildcard_stored": f"""SELECT * REPLACE ({YEAR} AS DATE_ID)
            FROM (SELECT {values} FROM ({ODD}) WHERE regexp_matches(LOWER(EUTRANCELLFDD), 's.a007'))""",
        "site_exact_odd_cells": f"SELECT {values} FROM ({ODD}) WHERE {EXACT}",
        "complement_nulls": f"""SELECT EUTRANCELLFDD, DATE_ID,
            Total_Traffic_Volume / 1000 AS Total_Traffic_Volume, 100 - LTE_CSFB_SR AS LTE_CSFB_SR
            FROM ({ODD})""",
        "hour_rollover": f"""SELECT EUTRANCELLFDD, SE_2, Total_Traffic_Volume,
            CAST(DATE_ID AS TIMESTAMP) + (HOUR_ID + CAST(SE_2 AS INTEGER)) * INTERVAL 1 HOUR
              AS DATE_ID FROM ({HOURLY})""",
        "default_dates": f"""SELECT * FROM (SELECT {values} FROM (SELECT * REPLACE (
            CAST(DATE_ID + INTERVAL {YEARS_LATER} YEAR AS DATE) AS DATE_ID) FROM ({DAILY})))
            WHERE DATE_ID BETWEEN DATE '2023-07-01' AND CURRENT_DATE""",
        "default_dates_hourly": f"""SELECT * FROM (SELECT {values} FROM (SELECT * REPLACE (
            CAST(CURRENT_DATE + CAST(DATE_ID - DATE '{RELOAD_FROM}' AS INTEGER) AS DATE) AS DATE_ID)
            FROM ({HOURLY}))) WHERE DATE_ID BETWEEN CURRENT_DATE - 3 AND CURRENT_DATE""",
        "arrow_round_trip": HOURLY,
        "write_published": f"SELECT * REPLACE ({YEAR} AS DATE_ID), {DIMENSIONS} FROM ({DAILY})",
        "kpi_mean_by_sector_cell_bucketed": rollup(
            "Monthly", "Sector, EUTRANCELLFDD", means, in_sector,
            daily=f"SELECT * REPLACE ({YEAR} AS DATE_ID) FROM ({DAILY})",
        ),
        "extract_good_rows": f"SELECT * FROM ({CLEANED}) WHERE pm_count NOT IN (6, 7)",
        "extract_rejected_rows": f"""SELECT CASE pm_count WHEN '7' THEN 'not as wide as the header'
              ELSE 'not a date' END AS reason,
            concat_ws(',', AREA, CASE pm_count WHEN '6' THEN 'x' ELSE '' END || DATE_ID, ERBS,
              EUTRANCELLFDD, Total_Traffic_Volume, pm_count, SE_2, RRC_Setup_Success_Rate_Service,
              Intra_Frequency_Handover_Out_Success_Rate
                || CASE pm_count WHEN '7' THEN ',1' ELSE '' END) AS row
            FROM ({RAW_DAILY}) WHERE pm_count IN ('6', '7')""",
        "coercion_report": _coerced(),
        "empty_reversed_range": report("Weekly", where="FALSE"),
        "empty_unknown_site": report("Weekly", where="FALSE"),
        "report_weekly_stored_daily": report("Weekly", daily=BUSY),
        "latest_date_loaded": f"SELECT MAX({YEAR}) AS most_recent_date FROM ({DAILY})",
        "cached_page_hit": report(
            "Weekly", where=f"{CONTAINS} AND {RANGE}", bands="('L1800', 'L900')", daily=BUSY
        ),
        "cached_page_reloaded": report(
            "Weekly", where=f"{CONTAINS} AND {RANGE}", bands="('L1800', 'L900')", daily=RELOADED
        ),
        "report_weekly_partials": report("Weekly", daily=BUSY),
        "report_monthly_partials_reloaded": report("Monthly", daily=RELOADED),
        "latest_date_stored": f"SELECT MAX(DATE_ID) AS most_recent_date FROM ({BUSY})",
        "cached_page_three_periods": "\nUNION ALL\n".join(
            f"SELECT * FROM ({report(p, where=f'{CONTAINS} AND {RANGE}')})"
            for p in ("Daily", "Weekly", "Monthly")
        ),
        "empty_selection": report("Weekly", where="FALSE"),
    }
    for p in PERIODS:
        name = p.lower()
        sql[f"traffic_by_band_{name}"] = rollup(p, "Band", traffic, "TRUE")
        sql[f"traffic_total_{name}"] = rollup(p, "", traffic, "TRUE")
        sql[f"traffic_by_sector_band_{name}"] = rollup(p, "Sector, Band", traffic, in_sector)
        sql[f"traffic_by_sector_cell_{name}"] = rollup(
            p, "Sector, EUTRANCELLFDD", traffic, in_sector
        )
        sql[f"kpi_mean_by_sector_cell_{name}"] = rollup(
            p, "Sector, EUTRANCELLFDD", means, in_sector
        )
        sql[f"report_{name}"] = report(p)
    return sql

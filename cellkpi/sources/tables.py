"""Fact tables: written by day, read back with pruning.

Facts are partitioned by ``DATE_ID`` and sorted by site and cell inside each file, with the cell's
dimensions stored. A date range then prunes partitions, a site prunes row groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from cellkpi.functions.cells import CELL
from cellkpi.sources.extracts import with_cell_dimensions

PARTITION = "DATE_ID"
GROUP = "SITE_GROUP"
MAX_RECORDS_PER_FILE = 2_000_000

# How each load mode treats what is there: Spark's save mode, and which partitions it overwrites.
LOAD_MODES = {
    "replace": ("overwrite", "static"),
    "append": ("append", "static"),
    "reload": ("overwrite", "dynamic"),
}


def site_group(groups: int) -> Column:
    """One of ``groups`` numbers that a site's rows share."""
    return F.pmod(F.xxhash64("SiteKey"), F.lit(groups)).cast("int")


def _by_day(
    facts: DataFrame, site_groups: int, partitions: Sequence[str] = (PARTITION,)
) -> DataFrame:
    """Rows of a day brought together for writing.

    ``rebalance`` lets adaptive execution split a day that is too large for one task and join small
    ones, so neither a busy day nor a long tail of quiet ones decides the run time.
    """
    stored = with_cell_dimensions(facts)
    order = [c for c in (*partitions, "SiteKey", CELL, "HOUR_ID") if c in stored.columns]
    together = list(partitions)
    if site_groups > 1:
        stored = stored.withColumn("__part", site_group(site_groups))
        together.append("__part")
    placed = stored.hint("rebalance", *together).sortWithinPartitions(*order)
    return placed.drop("__part")


STREAM_LOG = "_spark_metadata"


def exists(spark: SparkSession, path: str, name: str = "") -> bool:
    """Whether a file or folder exists, in whatever store the path is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}".rstrip("/"))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def check_batch_path(spark: SparkSession, path: str) -> None:
    """Raise if a stream fills the table at ``path``: its readers would not see other files."""
    if exists(spark, path, STREAM_LOG):
        raise ValueError(f"{path} is filled by a stream; batch loads need a table of their own")


def check_stream_path(spark: SparkSession, path: str) -> None:
    """Raise if ``path`` holds a table that no stream fills: a stream's log would hide its rows."""
    if exists(spark, path) and not exists(spark, path, STREAM_LOG):
        raise ValueError(f"{path} is filled by batch loads; a stream needs a table of its own")


def _writer(
    facts: DataFrame, mode: str, site_groups: int, partitions: Sequence[str] = (PARTITION,)
) -> DataFrameWriter:
    if mode not in LOAD_MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {list(LOAD_MODES)}")
    placed = _by_day(facts, site_groups, partitions)
    writer = placed.write.partitionBy(*partitions).mode(LOAD_MODES[mode][0])
    return writer.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)


def write_facts(
    facts: DataFrame,
    path: str,
    mode: str = "replace",
    *,
    site_groups: int = 1,
    partitions: Sequence[str] = (PARTITION,),
) -> None:
    """Write facts as Parquet.

    ``replace`` drops what was there, ``append`` adds to it, ``reload`` replaces only the days that
    ``facts`` holds, so that loading a day twice leaves it once.

    Days of many files may keep each site in one of ``site_groups`` parts of the day, so that a page
    of one site skips the other parts. A day gets at least as many files as it has groups.
    ``partitions`` may name one further column, of whole numbers, to make folders of within a day;
    ``reload`` then also removes the folders of its days that ``facts`` has no rows for.
    """
    writer = _writer(facts, mode, site_groups, partitions)
    check_batch_path(facts.sparkSession, path)
    writer.option("partitionOverwriteMode", LOAD_MODES[mode][1]).parquet(path)
    if mode == "reload" and len(partitions) > 1:
        _remove_left_over(facts, path, *partitions)


def _remove_left_over(facts: DataFrame, path: str, day: str, column: str) -> None:
    """Drop the folders of reloaded days that the load did not replace. It can be repeated."""
    spark = facts.sparkSession
    held: dict[str, set[str]] = {}
    for row in with_cell_dimensions(facts).select(day, column).distinct().collect():
        held.setdefault(f"{day}={row[0]}", set()).add(f"{column}={row[1]}")
    for name, kept in held.items():
        fs, folder = _fs(spark, f"{path.rstrip('/')}/{name}")
        for below in fs.listStatus(folder) if fs.exists(folder) else []:
            if below.getPath().getName().startswith(f"{column}=") and below.getPath().getName() not in kept:
                fs.delete(below.getPath(), True)


def save_facts(
    facts: DataFrame, table: str, mode: str = "replace", *, site_groups: int = 1
) -> None:
    """Write facts as a catalog table, with the choices of ``write_facts``."""
    spark = facts.sparkSession
    location = _location(spark, table)
    if location:
        check_batch_path(spark, location)
    if mode != "reload" or not location:
        _writer(facts, mode, site_groups).format("parquet").saveAsTable(table)
        return
    # Inserting would take the overwrite mode from the session, for all its jobs; the table's folder
    # takes it from the write. Then the catalog learns of days it has not seen. Both steps can be
    # repeated: after a failure between them, loading the same facts again completes the load.
    unknown = set(with_cell_dimensions(facts).columns) ^ set(spark.table(table).columns)
    if unknown:
        raise ValueError(f"columns that only the table or only the facts have: {sorted(unknown)}")
    write_facts(facts, location, "reload", site_groups=site_groups)
    spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)


def _location(spark: SparkSession, table: str) -> str | None:
    """The folder of a catalog table; none if there is no such table."""
    if not spark.catalog.tableExists(table):
        return None
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    return described.where("col_name = 'Location'").first().data_type


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_date(facts: DataFrame) -> DataFrame:
    """The last loaded day. On a table partitioned by day this reads no data column."""
    return facts.agg(F.max(PARTITION).alias("most_recent_date"))


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _holds_data(fs, folder) -> bool:
    """Whether a folder, or one below it, has a data file."""
    files = fs.listFiles(folder, True)
    while files.hasNext():
        file = files.next()
        if file.getLen() > 0 and file.getPath().getName()[0] not in "._":
            return True
    return False


def latest_loaded_date(spark: SparkSession, path: str) -> DataFrame:
    """The last day of a table written by ``write_facts``, from the names of its folders.

    No file is opened: Spark writes no file for a day without rows, and folders that a load or a
    clean-up left empty are passed over. Rows without a date are in no day. NULL if there is no day.
    """
    fs, pattern = _fs(spark, f"{path.rstrip('/')}/{PARTITION}=*")
    folders = {f.getPath().getName().split("=")[1]: f.getPath() for f in fs.globStatus(pattern) or []}
    days = sorted((d for d in folders if d != "__HIVE_DEFAULT_PARTITION__"), reverse=True)
    last = next((d for d in days if _holds_data(fs, folders[d])), None)
    return spark.sql("SELECT CAST(:day AS DATE) AS most_recent_date", {"day": last})


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders right below a folder."""
    fs, folder = _fs(spark, path)
    below = fs.listStatus(folder) if fs.exists(folder) else []
    return sorted(f.getPath().toString() for f in below if f.isDirectory())


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, folder = _fs(spark, path)
    fs.delete(folder, True)

"""Fact tables behind a name: replaced in one step, and bucketed by cell.

A published table is a catalog view over a folder of versions. A replace writes a new version aside and
then points the view to it in one catalog call: who planned a query before goes on reading the old files,
who plans one after sees the new ones, and a failure at any place before the call leaves the old version
in force. Old versions stay until they are released.

A bucketed table spares aggregations by cell their shuffle: rows of a cell lie in one bucket of each day,
so that sums and means per cell and day, week or month are computed where the rows are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellkpi.functions.cells import CELL
from cellkpi.sources.extracts import with_cell_dimensions
from cellkpi.sources.tables import PARTITION, delete_folder, list_folders, write_facts

CURRENT = "cellkpi.version"


def publish_facts(facts: DataFrame, name: str, root: str, *, site_groups: int = 1) -> str:
    """Replace the facts behind the view ``name``; returns the folder of the new version."""
    spark = facts.sparkSession
    folder = f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"
    write_facts(facts, folder, "replace", site_groups=site_groups)
    spark.sql(
        f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{CURRENT}' = '{folder}') "
        f"AS SELECT * FROM parquet.`{folder}`"
    )
    return folder


def current_version(spark: SparkSession, name: str) -> str:
    return spark.sql(f"SHOW TBLPROPERTIES {name} ('{CURRENT}')").first()["value"]


def release_versions(spark: SparkSession, name: str, root: str) -> list[str]:
    """Delete the versions that the view does not name; for when no reader is on them any more."""
    kept = current_version(spark, name).rstrip("/").rpartition("/")[2]
    old = [f for f in list_folders(spark, root) if f.rpartition("/")[2] not in ("", kept)]
    for folder in old:
        delete_folder(spark, folder)
    return old


def save_bucketed(
    facts: DataFrame, table: str, buckets: int, mode: str = "overwrite", by_day: bool = True
) -> None:
    """Facts as a catalog table bucketed and sorted by cell, one file per day and bucket.

    A day's bucket beyond the advisory partition size of adaptive execution gets several files, each written by
    a task of its own, so that what a task sorts does not grow with the facts. Reading streams: a task holds the
    groups of a bucket, not its rows.
    """
    stored = with_cell_dimensions(facts)
    # By the bucket itself, as Spark computes it, or every task would write every bucket; a rebalance, unlike
    # a repartition, also splits what is large.
    bucket = f"bucket_{uuid.uuid4().hex}"
    numbered = stored.withColumn(bucket, F.pmod(F.hash(CELL), F.lit(buckets)))
    placed = numbered.hint("rebalance", bucket, *([PARTITION] if by_day else [])).drop(bucket)
    writer = placed.write.bucketBy(buckets, CELL).sortBy(CELL).mode(mode)
    if by_day:
        writer = writer.partitionBy(PARTITION)
    writer.format("parquet").saveAsTable(table)

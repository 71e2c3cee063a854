"""Fact tables with an index of cell names, so that a text anywhere in a name finds few files.

Such a table is a folder of three: ``facts``, by day and site group (a hash of the site, so that a site
lies in one group of each day); ``cells``, every cell with its group; ``grams``, every run of ``GRAM``
characters of a lower-case cell name with the cells that hold it, sorted by run.

A text asked for, with LIKE's wildcards, has to hold its own literal runs: their cells are looked up,
those that have all of them are compared with the whole text, and what is left is joined to the facts.
The groups of those cells, at most as many as the table has, prune the facts' folders at run time. Texts
without a run of that length are compared with the cell list instead, which is still small beside the facts.

Loads add the cells that are new. A reload that drops a cell's last rows leaves it in the index, where
it finds nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellkpi.functions.cells import CELL
from cellkpi.operators.filters import check_site, dates_between, like_text
from cellkpi.sources.extracts import with_cell_dimensions
from cellkpi.sources.tables import (
    GROUP,
    PARTITION,
    exists,
    read_facts,
    site_group,
    write_facts,
)

GRAM = 3
GROUPS = 64


def _folders(path: str) -> tuple[str, str, str]:
    return tuple(f"{path.rstrip('/')}/{name}" for name in ("facts", "cells", "grams"))


def _grams(name: Column) -> Column:
    """The distinct runs of a name; a name shorter than a run has none."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - (GRAM - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.substr(name, i, F.lit(GRAM)))
    return F.array_distinct(F.filter(runs, lambda g: F.length(g) == GRAM))


def literal_runs(text: str) -> list[str]:
    """The runs that a name has to hold to match the text; none where an escape is in it."""
    if "\\" in text:
        return []
    parts = re.split("[_%]", text.lower())
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def write_indexed_facts(
    facts: DataFrame, path: str, mode: str = "replace", *, groups: int = GROUPS
) -> None:
    """Load facts as ``write_facts`` does, and the names of their cells into the index.

    The index goes first: a load that dies in between leaves names that find nothing yet.
    """
    spark = facts.sparkSession
    target, cells, grams = _folders(path)
    named = with_cell_dimensions(facts).withColumn(GROUP, site_group(groups))
    new = named.select(CELL, GROUP).where(F.col(CELL).isNotNull()).distinct()
    if mode != "replace" and exists(spark, cells):
        new = new.join(spark.read.parquet(cells), [CELL, GROUP], "left_anti")
    how = "overwrite" if mode == "replace" else "append"
    # Distinct cells are few beside the facts; one sorted file per task of the shuffle below.
    run = F.explode(_grams(F.lower(CELL))).alias("gram")
    by_run = new.select(run, CELL, GROUP).repartition("gram").sortWithinPartitions("gram")
    by_run.write.mode(how).parquet(grams)
    new.write.mode(how).parquet(cells)
    write_facts(named, target, mode, partitions=[PARTITION, GROUP])


def matching_cells(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(cell, site group) of the cells whose name holds the text, in any case."""
    _, cells, grams = _folders(path)
    runs = literal_runs(check_site(text))
    if runs:
        having = spark.read.parquet(grams).where(F.col("gram").isin(runs))
        per_cell = having.groupBy(CELL, GROUP).agg(F.count_distinct("gram").alias("runs"))
        named = per_cell.where(F.col("runs") == len(runs)).drop("runs")
    else:
        named = spark.read.parquet(cells).distinct()
    return named.where(like_text(F.col(CELL), text))


def read_matching(
    spark: SparkSession, path: str, text: str, start=None, end=None
) -> DataFrame:
    """Facts of the cells whose name holds the text; reads the site groups of those cells only."""
    facts = dates_between(read_facts(spark, _folders(path)[0]), start, end)
    found = matching_cells(spark, path, text)
    # No more rows than the table has groups, whatever the text.
    groups = F.broadcast(found.select(GROUP).distinct())
    return facts.join(groups, GROUP, "left_semi").join(found, [CELL, GROUP], "left_semi").drop(GROUP)

"""Page rows kept across calls and sessions, found again by what they were made of.

A page's rows are read once per site and date range; another band, period or chart is served from what
is kept. The key is a hash of the normalised plan of the rows and of the data files that lie in the
range. Files of a table are never changed in place (a load writes new names), so a reload of a day in
the range makes another key, one outside of it doesn't, and nothing is ever served stale. Entries are Parquet in a
folder that all executors share, written through Spark's commit protocol: an entry without its success
mark is not used.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellkpi.operators.filters import SITE_MODES, dates_between, in_bands
from cellkpi.plans.page import finish_rows
from cellkpi.sources.tables import PARTITION, exists, read_facts

DONE = "_SUCCESS"


class PageCache:
    """A folder of page rows. ``hits`` and ``misses`` count the calls of this object."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hits = self.misses = 0

    def rows(
        self,
        path: str,
        grain: str,
        *,
        site: str | None = None,
        site_mode: str = "contains",
        start: str | None = None,
        end: str | None = None,
        bands: list[str] | None = None,
    ) -> DataFrame:
        """``page_rows`` of the fact table at ``path``; bands are chosen from the kept rows."""
        facts = read_facts(self.spark, path)
        scope = dates_between(facts, start, end)
        if site is not None:
            scope = SITE_MODES[site_mode](scope, site)
        entry = f"{self.folder}/{self._key(scope, facts, start, end)}"
        if exists(self.spark, entry, DONE):
            self.hits += 1
        else:
            self.misses += 1
            self._write(scope, entry)
        kept = self.spark.read.schema(scope.schema).parquet(entry)
        return in_bands(finish_rows(kept, grain, site, site_mode), bands)

    def _key(self, scope: DataFrame, facts: DataFrame, start: str | None, end: str | None) -> str:
        plan = scope._jdf.queryExecution().optimizedPlan().canonicalized().toString()
        parts = [plan, *sorted(f for f in facts.inputFiles() if in_range(f, start, end))]
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()

    def _write(self, scope: DataFrame, entry: str) -> None:
        """Write aside and rename, so that two calls at once leave one whole entry."""
        aside = f"{self.folder}/.{uuid.uuid4().hex}"
        scope.write.parquet(aside)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(aside).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if exists(self.spark, entry) or not fs.rename(path(aside), path(entry)):
            fs.delete(path(aside), True)

    def clear(self) -> None:
        """Remove all entries, for instance those of files that are long gone."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def in_range(file: str, start: str | None, end: str | None) -> bool:
    """Whether a data file is of a day in the range; files that name no day always are."""
    for part in file.split("/"):
        if part.startswith(f"{PARTITION}="):
            day = part.partition("=")[2]
            return not day[:1].isdigit() or (str(start or day) <= day <= str(end or day))
    return True

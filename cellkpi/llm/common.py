"""Helpers that several operators share: scratch tables, sized Arrow batches and row grouping."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellkpi.session import scratch_path

TEXT_BYTES = 4 << 20
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again, which cuts its lineage.

    Shuffle files of the job are released when it has ended rather than when the driver happens to
    collect garbage: nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (written := _written.get()) is not None:
        written.append(path)
    before = spark.conf.get(RELEASE_SHUFFLES, "false")
    spark.conf.set(RELEASE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(RELEASE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until ``df`` has no such column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` stored with a number that no two rows share, and that column's name."""
    name = free_name(df, "__row")
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` returned, once nothing will read it again."""
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, ``stored``; all other tables that were stored on the way are deleted then."""
    before = _written.set([])
    try:
        made = make()
        spark, scratch = made.sparkSession, list(_written.get())
        result = stored(made, name)
        for folder in scratch:
            _delete(spark, folder)
    finally:
        _written.reset(before)
    return result


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with ``value`` computed once per row, however often it is used.

    A plain reference may be copied by the optimiser into a lambda and computed per element there.
    """
    return F.transform(F.array(value), body)[0]


def sized_slices(
    batches: Iterable[pa.RecordBatch], column: int, most: int = TEXT_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts in ``column`` hold about ``most`` bytes; at least a row."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin = held = 0
        for row, length in enumerate(lengths):
            if held and held + length > most:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += length
        if begin < batch.num_rows:
            yield batch.slice(begin)


def grouped_chunks(
    batches: Iterable[pa.RecordBatch], key: str, rows: int = 50_000, most: int = 1 << 62
) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``key`` from batches sorted by it, of about ``rows`` rows or ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    count = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        size += batch.nbytes
        if count < rows and size < most:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key)
        same = pc.sum(pc.equal(keys, keys[-1])).as_py()  # sorted, so these are the last rows
        if same == whole.num_rows:
            continue
        yield whole.slice(0, whole.num_rows - same)
        held = whole.slice(whole.num_rows - same).combine_chunks().to_batches()
        count, size = same, sum(part.nbytes for part in held)
    if held:
        yield pa.Table.from_batches(held)

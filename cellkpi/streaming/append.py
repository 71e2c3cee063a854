"""The append load as a stream: every extract file that lands in a folder is loaded once.

The steps are those of the batch load. The stream's checkpoint remembers which files are done, and
the Parquet sink commits each batch as a whole, so a load that dies and is started again neither
loses nor repeats a file. A table filled this way takes no batch loads, and the other way round:
readers follow the stream's own list of files. Both are refused. Rows of a day are brought together
before they are written, so a batch leaves as many files per day as a batch load would; they are not
sorted by site, which streams do not allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from cellkpi.sources.extracts import csv_options, header_schema, with_cell_dimensions
from cellkpi.sources.tables import PARTITION, check_stream_path


def stream_extracts(
    spark: SparkSession, folder: str, max_files: int = 1000, *, multi_line: bool = False
) -> DataFrame:
    """Extract files in ``folder`` as a stream of text columns named by their header."""
    reader = spark.readStream.options(**csv_options(multi_line))
    reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.schema(header_schema(spark, folder, multi_line)).csv(folder)


def append_facts(facts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of cleaned facts to the table at ``path`` until the input is used up."""
    check_stream_path(facts.sparkSession, path)
    by_day = with_cell_dimensions(facts).hint("rebalance", PARTITION)
    writer = by_day.writeStream.format("parquet").partitionBy(PARTITION)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def append_rejected(rejected: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rejected rows of a stream (``extracts.split_rows``) to a table of their own."""
    check_stream_path(rejected.sparkSession, path)
    writer = rejected.writeStream.format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()

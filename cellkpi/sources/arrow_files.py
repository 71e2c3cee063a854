"""Results as Arrow files: tasks write them, tasks read them, nothing passes the driver.

``session.dataSource.register(ArrowFiles)`` makes the format ``arrow_files``. Each writing task streams
its record batches into one file of its own under ``_temporary`` and reports name and rows; the commit
moves the files into place and writes ``_SUCCESS`` with their count. A task that dies leaves its file
under ``_temporary``, where no reader looks, and the abort removes it. Folders may be in any store that
pyarrow opens by URI; plain paths are local or mounted.

``overwrite`` removes the earlier files after the new ones are in place, in the commit; ``append`` keeps
them; the default raises where there are some.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

FORMAT, ENDING, ASIDE, DONE = "arrow_files", ".arrow", "_temporary", "_SUCCESS"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def data_files(path: str) -> list[str]:
    """The files of a folder that are in place, by name."""
    store, folder = opened(path)
    found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(ENDING))


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema = path, to_arrow_schema(schema)
        self.job, self.overwrite = uuid.uuid4().hex, overwrite

    def _aside(self, folder: str) -> str:
        return f"{folder}/{ASIDE}/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = opened(self.path)
        store.create_dir(self._aside(folder), recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05}-{self.job}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}{ENDING}"
        rows, sink, writer = 0, None, None
        try:
            for batch in iterator:
                if writer is None:
                    sink = store.open_output_stream(f"{self._aside(folder)}/{name}")
                    writer = pa.ipc.new_file(sink, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
                sink.close()
        return Written(name if writer is not None else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        earlier = data_files(self.path) if self.overwrite else []
        store.create_dir(folder, recursive=True)
        written = [m for m in messages if m is not None and m.name]
        if not written:  # a file without batches keeps the schema
            written = [Written(f"part-empty-{self.job}{ENDING}", 0)]
            store.create_dir(self._aside(folder), recursive=True)
            with store.open_output_stream(f"{self._aside(folder)}/{written[0].name}") as sink:
                pa.ipc.new_file(sink, self.schema).close()
        for message in written:
            store.move(f"{self._aside(folder)}/{message.name}", f"{folder}/{message.name}")
        for file in earlier:
            store.delete_file(file)
        store.delete_dir(f"{folder}/{ASIDE}")
        with store.open_output_stream(f"{folder}/{DONE}") as mark:
            mark.write(f"{sum(m.rows for m in written)} rows\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        if store.get_file_info(self._aside(folder)).type == pafs.FileType.Directory:
            store.delete_dir(self._aside(folder))


@dataclass
class File(InputPartition):
    path: str


class ArrowReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        return [File(f) for f in data_files(self.path)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        with store.open_input_file(partition.path) as source:
            file = pa.ipc.open_file(source)
            for i in range(file.num_record_batches):
                yield file.get_batch(i)


class ArrowFiles(DataSource):
    """``spark.read.format("arrow_files").load(folder)`` and ``df.write.format("arrow_files")``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        files = data_files(self.options["path"])
        if not files:
            raise ValueError(f"no Arrow files in {self.options['path']}")
        store, _ = opened(self.options["path"])
        with store.open_input_file(files[0]) as source:
            return from_arrow_schema(pa.ipc.open_file(source).schema)

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options["path"], schema, overwrite)


def write_arrow(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Hand a result over as Arrow files, one per task that has rows."""
    if mode not in ("errorifexists", "overwrite", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "errorifexists" and data_files(path):
        raise ValueError(f"{path} holds Arrow files already")
    df.sparkSession.dataSource.register(ArrowFiles)
    how = "append" if mode == "errorifexists" else mode
    df.write.format(FORMAT).mode(how).option("path", path).save()


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowFiles)
    return spark.read.format(FORMAT).option("path", path).load()

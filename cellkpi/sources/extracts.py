"""From CSV extract to cleaned facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellkpi.functions import cells
from cellkpi.functions.values import to_date, to_number
from cellkpi.sources.schema import MISSING_TEXTS, TEXT_COLUMNS, check_columns, clean_names

DIMENSIONS = {
    "SiteID": cells.site_id,
    "Band": cells.band,
    "Sector": cells.sector,
    "NEID": cells.network_element,
    "SiteKey": cells.site_key,
}


CSV_DIALECT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def csv_options(multi_line: bool = False) -> dict[str, object]:
    """How extracts are read, in batch and as a stream: doubled quotes, every row as wide as the header.

    Whole rows are parsed whatever columns are used, so that a row with fields to spare, or one that
    a quoted line break splits, fails the job instead of losing or shifting values. ``multi_line``
    reads line breaks in quotes; such files are not split over tasks.
    """
    strict = {"enforceSchema": False, "mode": "FAILFAST", "columnPruning": False}
    return {**CSV_DIALECT, **strict, "multiLine": multi_line}


def header_schema(spark: SparkSession, path: str, multi_line: bool = False) -> T.StructType:
    """The header of an extract as a schema of text columns; reads one line."""
    names = spark.read.options(**CSV_DIALECT, multiLine=multi_line).csv(path).columns
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_extract(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """An extract as text under its own header names.

    Each file's header is checked against the first one's, so a file with its columns in another
    order fails instead of landing in the wrong columns.
    """
    reader = spark.read.options(**csv_options(multi_line))
    return reader.schema(header_schema(spark, path, multi_line)).csv(path)


def choose_date_format(
    named: DataFrame, formats: Sequence[str], missing_texts: Sequence[str] = MISSING_TEXTS
) -> str:
    """The first of the formats that reads every date of a load; raises if none does.

    ``04/05/2023`` fits two formats, so a choice per value could turn one column's days into different
    ones. All formats are judged in one pass over the date column that shuffles one row per task.
    """
    formats = list(formats)
    if len(formats) == 1:
        return formats[0]
    if named.isStreaming:
        raise ValueError("a stream needs one date format, or mix_formats=True")
    text = F.col("DATE_ID")
    known = F.when(~text.isin(list(missing_texts)) & (text != ""), text)
    fits = [
        F.bool_and(known.isNull() | F.try_to_date(known, f).isNotNull()).alias(f"f{i}")
        for i, f in enumerate(formats)
    ]
    found = named.agg(*fits).first()
    for format_, good in zip(formats, found, strict=True):
        if good is not False:
            return format_
    raise ValueError(f"no format of {formats} reads all dates of the extract")


CORRUPT = "_corrupt_row"


def read_extract_rows(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """An extract as text that goes on past rows of another width than the header.

    Such a row's text is in ``_corrupt_row``, NULL for the others; ``_file`` names the file. Split the
    rows with ``split_rows``. Files with another header still fail.
    """
    schema = header_schema(spark, path, multi_line).add(CORRUPT, T.StringType())
    return _lenient(spark.read, multi_line).schema(schema).csv(path).select("*", _file())


def stream_extract_rows(
    spark: SparkSession, folder: str, max_files: int = 1000, *, multi_line: bool = False
) -> DataFrame:
    """The same for files that land in a folder, as a stream."""
    schema = header_schema(spark, folder, multi_line).add(CORRUPT, T.StringType())
    reader = _lenient(spark.readStream, multi_line).option("maxFilesPerTrigger", max_files)
    return reader.schema(schema).csv(folder).select("*", _file())


def _file() -> Column:
    return F.col("_metadata.file_path").alias("_file")


def _lenient(reader, multi_line: bool):
    options = {**csv_options(multi_line), "mode": "PERMISSIVE"}
    return reader.options(**options).option("columnNameOfCorruptRecord", CORRUPT)


def split_rows(
    raw: DataFrame, *, date_format: str | list[str] | None = None, **cleaning
) -> tuple[DataFrame, DataFrame]:
    """(facts, rejected) of rows read by ``read_extract_rows`` or ``stream_extract_rows``.

    ``rejected`` has the file, the row's text and the reason: a row that is not as wide as the header, or
    whose date can't be read. Every input row is in one of the two. ``cleaning`` is that of ``clean_extract``.
    """
    columns = [c for c in raw.columns if c not in (CORRUPT, "_file")]
    day = next(c for c in columns if clean_names(raw.select(c)).columns == ["DATE_ID"])
    absent = cleaning.get("missing_texts")
    text = F.col(day)
    known = ~text.isin(MISSING_TEXTS if absent is None else absent or [""]) & (text != "")
    unread = known & to_date(text, date_format, strict=False).isNull()
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "not as wide as the header")
        .when(F.coalesce(unread, F.lit(False)), "not a date")
        .alias("reason")
    )
    marked = raw.select("*", reason)
    good = marked.where(F.col("reason").isNull()).select(*columns)
    row = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*columns), {"escape": '"'}))
    rejected = marked.where(F.col("reason").isNotNull()).select(
        F.col("_file").alias("file"), row.alias("row"), "reason"
    )
    return clean_extract(good, date_format=date_format, strict_dates=False, **cleaning), rejected


def observe_coercions(raw: DataFrame, observation: Observation, text_columns=None) -> DataFrame:
    """``raw`` with counts of the texts that ``clean_extract`` turns into missing numbers.

    The counts are gathered while the frame is used, by the write of the load for instance; read them with
    ``coercions`` once that is done.
    """
    keep = TEXT_COLUMNS if text_columns is None else text_columns
    parts = []
    for name, clean in zip(raw.columns, clean_names(raw).columns, strict=True):
        if clean == "DATE_ID" or clean in keep:
            continue
        text = F.col(f"`{name}`")
        lost = text.isNotNull() & to_number(text).isNull()
        parts += [
            F.count_if(lost).alias(f"n_{clean}"),
            F.min(F.when(lost, text)).alias(f"first_{clean}"),
        ]
    return raw.observe(observation, *parts)


def coercions(spark: SparkSession, observation: Observation) -> DataFrame:
    """(column, coerced, example): per number column, the texts that became missing and the least of them."""
    found = observation.get
    rows = [(n[2:], v, found[f"first_{n[2:]}"]) for n, v in found.items() if n.startswith("n_")]
    return spark.createDataFrame(rows, "column string, coerced long, example string")


def clean_extract(
    raw: DataFrame,
    *,
    grain: str | None = None,
    text_columns: list[str] | None = None,
    missing_texts: list[str] | None = None,
    date_format: str | list[str] | None = None,
    strict_dates: bool = True,
    mix_formats: bool = False,
) -> DataFrame:
    """Clean names, parse ``DATE_ID`` and turn every other non-text column into numbers.

    With a ``grain``, missing and unknown columns raise. A text column whose value is one of
    ``missing_texts`` is NULL; an empty list keeps all texts. Of several date formats one is chosen for
    the load (``choose_date_format``, a pass over the dates); ``mix_formats`` tries them value by value.
    """
    keep = TEXT_COLUMNS if text_columns is None else text_columns
    absent = MISSING_TEXTS if missing_texts is None else missing_texts
    named = clean_names(raw)
    if grain is not None:
        check_columns(named.columns, grain)
    if date_format is not None and not isinstance(date_format, str) and not mix_formats:
        date_format = choose_date_format(named, date_format, absent)

    def convert(name: str):
        text = F.col(name)
        if (name == "DATE_ID" or name in keep) and absent:
            text = F.when(~text.isin(absent), text)
        if name == "DATE_ID":
            return to_date(text, date_format, strict=strict_dates).alias(name)
        if name in keep:
            return text.alias(name)
        number = to_number(text)
        return (number.try_cast("int") if name == "HOUR_ID" else number).alias(name)

    return named.select([convert(c) for c in named.columns])


def with_cell_dimensions(df: DataFrame) -> DataFrame:
    """All columns plus the dimensions of the cell; those a fact table already stores are kept."""
    missing = {n: make() for n, make in DIMENSIONS.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df

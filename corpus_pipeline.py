"""From raw documents to encoded training text: five operators, each over all that the last kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellkpi.llm.byte_pairs import encode_decode
from cellkpi.llm.common import discard, stored_alone, table
from cellkpi.llm.line_quality import WIDE, clean_documents
from cellkpi.llm.mixture import repeat_mixture
from cellkpi.llm.near_copies import one_of_each_copy
from cellkpi.llm.private_data import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` set again, after their texts have changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines leave the texts; rejected documents go."""
    return _measured(clean_documents(docs, WIDE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts with a five-word Jaccard of 0.8 or more stays, the one with the
    least id; nulls come last."""
    return one_of_each_copy(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return _measured(redact(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that sources, languages and topics meet their targets."""
    return repeat_mixture(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, with hashes of the ids and of the text decoded from them."""
    return encode_decode(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("mixture", mixture),
    ("encoding", encoding),
]

# Hashes of fingerprints, the fit of the mixture and token ids can't be said in SQL; the stages and
# the whole are tested against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again by the next.

    A stage's own scratch tables, and its input, are deleted when its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES[:-1]):
        result = stored_alone(partial(stage, spark, docs, sf_dir), name)
        if place:
            discard(docs)
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)

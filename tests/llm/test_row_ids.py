"""Rows that share an id, or have none, are told apart by the stages that drop or change texts."""

from pyspark.sql import functions as F

from cellkpi.llm import private_data, simhash_dedup
from tests.llm.test_queries import SCHEMA

WORDS = " ".join(f"word{i}" for i in range(100))


def test_each_row_is_redacted_by_its_own_spans(spark):
    docs = [
        (1, "Write to ann@example.org today."),
        (1, "No person is named in this text, and nothing goes."),
        (1, "By phone: +1 202 555 0147 or ben@example.org"),
        (None, "A longer start before cat@example.org"),
        (None, "dan@example.org"),
        (None, None),
    ]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("__row", F.lit("kept"))
    out = private_data.redact(df)
    assert out.columns == df.columns
    expected = [
        (1, "By phone: [PHONE] or [EMAIL]"),
        (1, "No person is named in this text, and nothing goes."),
        (1, "Write to [EMAIL] today."),
        (None, "A longer start before [EMAIL]"),
        (None, "[EMAIL]"),
        (None, None),
    ]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(expected, key=str)


def test_one_row_of_repeated_and_null_ids_stays(spark):
    docs = [(4, WORDS), (4, WORDS), (None, WORDS), (9, WORDS)]
    docs += [(None, "only nulls have this text"), (None, "only nulls have this text")]
    docs += [(4, "a text of its own under the same id")]
    out = simhash_dedup.one_of_each(spark.createDataFrame(docs, SCHEMA).repartition(3))
    rows = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert rows == sorted({(4, WORDS), docs[4], docs[6]}, key=str)

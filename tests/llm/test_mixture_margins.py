"""Tokens of the repeated sample meet the targets, also where a cell needs more than it has."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellkpi.llm import mixture as mx


def test_sampled_tokens_meet_the_margins(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.lit("some words").alias("text"),
        F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"),
        F.when(F.col("id") % 40 == 0, "rare").otherwise("hot").alias("source"),
        F.lit(1).alias("__copy"),
    )
    targets = {"source": {"rare": 0.14, "hot": 0.86}, "lang": {"de": 0.6, "en": 0.4}}
    kept = mx.repeat_mixture(df, mx.Mixture(targets))
    assert kept.columns == df.columns
    rows = kept.groupBy("source", "lang").count().collect()
    total = sum(r["count"] for r in rows)
    assert total == pytest.approx(20_000, rel=0.02)
    for margin, shares in targets.items():
        for name, share in shares.items():
            held = sum(r["count"] for r in rows if r[margin] == name)
            assert held / total == pytest.approx(share, abs=0.01)


def test_stage_meets_the_tempered_languages(spark):
    df = spark.range(10_000).select(
        F.col("id").alias("doc_id"),
        F.lit("some words").alias("text"),
        F.lit("web").alias("source"),
        F.when(F.col("id") % 50 == 0, "es").otherwise("en").alias("lang"),
    )
    out = dict(corpus_pipeline.STAGES)["mixture"](spark, df, "")
    want = 0.02**0.7 / (0.02**0.7 + 0.98**0.7)
    assert out.where("lang = 'es'").count() / out.count() == pytest.approx(want, abs=0.005)

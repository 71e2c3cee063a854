import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cellkpi.llm import mixture as mx


def fit(cells, shares, rounds=200):
    """Plain raking of {(source, lang, topic): tokens} to one share table per margin."""
    total = sum(cells.values())
    fitted = {c: t / total for c, t in cells.items()}
    for _ in range(rounds):
        for m, share in enumerate(shares):
            sums = defaultdict(float)
            for c, w in fitted.items():
                sums[c[m]] += w
            fitted = {
                c: w * share.get(c[m], 0) / sums[c[m]] if sums[c[m]] else 0
                for c, w in fitted.items()
            }
    return {c: fitted[c] * total / t for c, t in cells.items() if t}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "c", None])
        lang = rng.choice(["en", "en", "de"] if source == "a" else ["en", "de", "fr"])
        text = rng.choice(["x " * rng.randrange(1, 3000), "a | b | c\n" * 9, "l\n" * 300, "", None])
        rows.append((i, text, lang, source, "extra"))
    return rows, spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, factor string"
    )


@pytest.mark.parametrize("targets", [{}, {"source": {"a": 0.5, "b": 0.2, "none": 1.0}}])
def test_factors_like_plain_raking(docs, targets):
    rows, df = docs
    got = mx.mixing_report(df, mx.Mixture(targets, rounds=100, tolerance=1e-10)).collect()
    assert len(got) == len(rows)
    cells = defaultdict(float)
    for r in got:
        cells[r.source, r.lang, r.topic] += r.tokens
    shares = []
    for m, name in enumerate(mx.MARGINS):
        held = defaultdict(float)
        for c, t in cells.items():
            held[c[m]] += t
        held = {k: v for k, v in held.items() if v}
        want = {k: v**0.7 for k, v in held.items()}
        if name in targets:
            want = {k: targets[name][k] for k in held if k in targets[name]}
        shares.append({k: v / sum(want.values()) for k, v in want.items()})
    factors = fit(cells, shares)
    for r in got:
        factor = factors.get((r.source, r.lang, r.topic), 1.0)
        assert r.chance == pytest.approx(min(1, factor), abs=1e-7)
        assert r.weight == pytest.approx(max(1, factor), rel=1e-6)
        assert {0.0: False, 1.0: True}.get(r.chance, r.kept) == r.kept
    assert {r.topic for r in got} == {"empty", "table", "note", "list", "article", "long"}


def test_sample_keeps_columns_and_repeats(docs):
    _, df = docs
    kept = mx.sample_mixture(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    again = mx.mixing_report(df.repartition(7)).where("kept")
    assert ids == sorted(r.doc_id for r in again.collect())


def test_draws_follow_the_chances(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.lit("some words").alias("text"),
        F.lit("en").alias("lang"),
        F.when(F.col("id") % 4 == 0, "rare").otherwise("hot").alias("source"),
    )
    targets = {"source": {"rare": 0.5, "hot": 0.5}}
    kept = mx.sample_mixture(df, mx.Mixture(targets, scale=0.5)).groupBy("source").count()
    counts = {r.source: r["count"] for r in kept.collect()}
    assert counts["rare"] == 5000
    assert counts["hot"] == pytest.approx(5000, rel=0.05)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mx.mixing_report(df).collect() == []
    assert mx.sample_mixture(df).collect() == []

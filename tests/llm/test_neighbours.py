import numpy as np
import pytest
from pyspark.sql import functions as F

from cellkpi.llm import neighbours as nn


def brute(ids, vectors, queries, k=5):
    """query id -> [(id, score)] of the k nearest, ties to the smaller id."""
    out = {}
    for q in queries:
        a = np.array(vectors[ids.index(q)], float)
        scores = []
        for i, v in zip(ids, vectors, strict=True):
            b = np.array(v, float)
            if i != q:
                scores.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 12), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_recall_on_the_table(spark, sf_dir, block):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.collect()
    ids, vectors = [r.vec_id for r in rows], [r.embedding for r in rows]
    got = found(nn.nearest_neighbours(table, F.col("id") % 50 == 0, block=block).collect())
    expected = brute(ids, vectors, [i for i in ids if i % 50 == 0])
    assert got.keys() == expected.keys()
    hits = sum(len(set(got[q]) & set(expected[q])) for q in expected)
    assert hits >= 0.95 * sum(map(len, expected.values()))


def test_exact_where_every_axis_is_probed(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 6)).astype("float32").round(1)
    vectors[10:30] = vectors[9]  # a vector that fills half of the table
    vectors[30:34] = 2 * vectors[9]
    ids = list(range(40))
    df = spark.createDataFrame(
        [(i, [float(x) for x in v], "x") for i, v in zip(ids, vectors, strict=True)],
        "vec_id long, embedding array<float>, axis string",
    )
    df = df.unionAll(df.where("vec_id < 5"))
    got = found(nn.nearest_neighbours(df, F.col("id") % 3 == 0, probes=16, block=8).collect())
    assert got == brute(ids, vectors.tolist(), ids[::3])


@pytest.mark.parametrize("size", [64, 384, 768])
def test_recall_and_no_short_answers_at_any_size(spark, size):
    rng = np.random.default_rng(size)
    for n in (4, 6, 20, 1000):
        vectors = rng.normal(size=(n, size)).round(3).tolist()
        df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
        step = 1 if n < 100 else 50
        got = found(nn.nearest_neighbours(df, F.col("id") % step == 0).collect())
        expected = brute(list(range(n)), vectors, range(0, n, step))
        assert {q: len(x) for q, x in got.items()} == {q: min(5, n - 1) for q in expected}
        hits = sum(len(set(got[q]) & set(expected[q])) for q in expected)
        assert hits >= 0.9 * sum(map(len, expected.values())), (n, hits)
        if n <= 6:
            assert got == expected


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]),
        (1, [1e200, 1e200]),
        (2, [0.0, 0.0]),
        (3, None),
        (4, [1.0, None]),
        (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]),
        (7, []),
        (8, [1.0, 2.0, 3.0]),
        (None, [1.0, 0.5]),
        (50, [1e-200, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nn.neighbours_query(df).collect())
    half = round(float(np.sqrt(0.5)), 12)
    assert got == {0: [(50, 1.0), (1, half)], 50: [(0, 1.0), (1, half)]}


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nn.neighbours_query(df).collect() == []

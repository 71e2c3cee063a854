import numpy as np
import pytest
from pyspark.sql import functions as F

from cellkpi.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, step=100):
    rows = [(i, lab, [int(np.floor(256 * c)) for c in v]) for i, lab, v in rows]
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, x) for i, lab, x in rows]
    out = []
    for n, (i, lab, x) in enumerate(rows):
        if i % step:
            continue
        scores = [(-sum(map(int.__mul__, x, y)), j, m) for m, (j, _, y) in enumerate(rows) if m != n]
        same = sorted(s for s in scores if rows[s[2]][1] == lab)[:5]
        for p, j, _ in same:
            some = [s for s in scores if rows[s[2]][1] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out += [(i, j, k, m, -p, -q) for k, (q, m, _) in enumerate(sorted(some)[:10], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("blocks", [(16_384, 8_192), (3, 11)])
def test_like_brute_force_with_ties_repeats_and_a_hot_vector(spark, blocks, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-3, 4, (300, 5)) / 4
    vectors[100:200] = vectors[3]  # a third of the rows, many of them anchors
    labels = rng.integers(0, 4, 300)
    rows = [(int(i), int(x), v.tolist()) for i, x, v in zip(range(0, 3000, 10), labels, vectors, strict=True)]
    rows += rows[:20]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("x"), "slot": F.lit(1)})
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hn.hard_negatives(
        table.withColumn("label", turned), F.col("id") % 100 == 0,
        anchor_block=blocks[0], row_block=blocks[1],
    )
    assert result(found) == brute(rows)


def test_odd_rows_take_no_part(spark):
    some = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.5]), (3, 2, [-1.0, 0.0])]
    odd = [(None, 1, [9.0, 9.0]), (4, None, [9.0, 9.0]), (5, 1, None), (6, 1, [9.0, None])]
    odd += [(8, 1, [float("nan"), 9.0]), (9, 2, [float("inf"), 0.0]), (10, 1, [9.0, 9.0, 9.0])]
    found = hn.hard_negatives(spark.createDataFrame(some + odd, SCHEMA), F.col("id") == 0)
    assert result(found) == [(0, 1, 1, 2, 131072, 65536)]
    assert hn.hard_negative_query(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], SCHEMA)
    assert hn.hard_negative_query(alone).collect() == []


def test_scores_are_exact_for_large_and_long_vectors(spark):
    rng = np.random.default_rng(3)
    for size, most in ((7, 1 << 28), (3000, 1 << 20), (1, 1 << 30), (64, 200)):
        a, b = rng.integers(-most, most, (2, 6, size))
        largest = int(max((x.astype(object) ** 2).sum() for x in (*a, *b)))
        primes = hn.residue_primes(size, largest)
        half = max(primes) // 2
        assert half * half * min(size, hn.SLICE) <= 1 << 24
        got = hn.exact_scores(hn.residues(a, primes), hn.residues(b, primes), primes)
        assert (got == a.astype(object) @ b.T.astype(object)).all()


def test_products_beyond_a_long_raise(spark):
    table = spark.createDataFrame([(0, 1, [1e9]), (1, 1, [1e9])], SCHEMA)
    with pytest.raises(ValueError, match="do not fit"):
        hn.hard_negative_query(table)

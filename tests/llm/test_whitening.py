import numpy as np
import pytest
from pyspark.sql import functions as F

from cellkpi.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows):
    """id -> whitened, deviation; n, explained of the four components, from a float eigensolver."""
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows]
    fit = np.unique([x for _, x in kept], axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {
        i: ((x - sums / n) @ vectors[:, :4] / np.sqrt(values[:4]), int(((n * x - sums) ** 2).sum()))
        for i, x in kept
    }
    return out, n, values[:4] / values.sum()


def check(spark, rows, found):
    expected, n, explained = brute(rows)
    got = {}
    for r in found:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert got.keys() == expected.keys()
    table = np.array([[got[i][c].whitened for c in (1, 2, 3, 4)] for i in sorted(got)])
    plain = np.array([expected[i][0] for i in sorted(got)])
    turn = np.sign((table * plain).sum(axis=0))  # either sign, one for all rows
    assert np.allclose(table, plain * turn, atol=1e-8)
    for i, parts in got.items():
        for c, r in parts.items():
            assert (r.n, r.deviation) == (n, expected[i][1])
            assert abs(r.explained / explained[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(spark, rows, w.whitening_query(table).collect())


def test_repeated_vectors_count_once_and_odd_rows_go(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(60, 6)) * [9, 5, 3, 2, 1, 0.5]).round(2).tolist()
    rows = list(enumerate(vectors + [vectors[0]] * 90 + [[0.0] * 6]))
    odd = [(900, None), (901, [1.0, None, 0.0]), (902, [float("nan")] * 6), (903, [])]
    odd.append((904, [float("inf")] + [0.0] * 5))
    table = spark.createDataFrame(rows + odd, SCHEMA).withColumns({"component": F.lit("x"), "x": F.lit(1)})
    check(spark, rows, w.whitening_query(table.repartition(7)).collect())
    again = w.whitening_query(table.unionAll(table.where("vec_id = 5"))).where("vec_id = 5")
    assert again.count() == 8
    assert w.whitening_query(table.withColumn("vec_id", F.lit(None).cast("long"))).count() == 4 * len(rows)


def test_no_variance_few_dimensions_and_lengths_apart(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0]), (3, [4.0]), (4, [7.0])]
    found = w.whitening_query(spark.createDataFrame(rows, SCHEMA)).collect()
    alone = [r for r in found if r.vec_id < 2]
    assert len(alone) == 4  # two components of two vectors, without variance
    assert all((r.n, r.deviation, r.whitened, r.explained) == (1, 0, None, None) for r in alone)
    rest = sorted((r.vec_id, r.whitened) for r in found if r.vec_id > 1)
    x = 256 * np.array([3.0, 4.0, 7.0])
    assert np.allclose([v for _, v in rest], (x - x.mean()) / x.std())


def test_rank_below_the_components(spark):
    rows = [(i, [float(i), 2.0 * i, -1.0 * i, 0.0]) for i in range(5)]
    found = w.whitening_query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 20
    assert all((r.whitened is None) == (r.component > 1) for r in found)
    assert all(r.explained == (1.0 if r.component == 1 else 0.0) for r in found)


def test_empty_table_and_entries_too_large(spark):
    assert w.whitening_query(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(Exception, match="too large"):
        w.whitening_query(spark.createDataFrame([(1, [1e20])], SCHEMA))


def test_polynomial_by_primes_and_roots_by_sign_changes(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-(1 << 20), 1 << 20, (9, 7)).astype(object)
    matrix = x.T @ x
    polynomial = w.characteristic_polynomial(spark, matrix)
    for at in (0, 1, -3, 12345):  # det(at - M), without division
        assert sum(c * at**i for i, c in enumerate(polynomial)) == determinant(
            at * np.eye(7, dtype=int).astype(object) - matrix
        )
    values = np.linalg.eigvalsh(matrix.astype(float))[::-1]
    roots = w.largest_roots(polynomial, 7)
    assert np.allclose([float(r.middle()) for r in roots], values, rtol=1e-9)


def determinant(m):
    """Bareiss' elimination: exact for integers."""
    m, size, sign, before = [list(map(int, r)) for r in m], len(m), 1, 1
    for k in range(size - 1):
        if not m[k][k]:
            swap = next((i for i in range(k + 1, size) if m[i][k]), None)
            if swap is None:
                return 0
            m[k], m[swap], sign = m[swap], m[k], -sign
        for i in range(k + 1, size):
            for j in range(k + 1, size):
                m[i][j] = (m[i][j] * m[k][k] - m[i][k] * m[k][j]) // before
        before = m[k][k]
    return sign * m[-1][-1]


def test_equal_roots_share_a_space(spark):
    diagonal = np.diag([5, 5, 5, 3, 3, 1, 0]).astype(object)
    polynomial = w.characteristic_polynomial(spark, diagonal)
    roots = w.largest_roots(polynomial, 7)
    assert [float(r.middle()) for r in roots] == pytest.approx([5, 5, 5, 3, 3, 1])
    assert [r.count for r in roots] == [3, 3, 3, 2, 2, 1]
    some = np.array(w.null_vectors(diagonal, roots[0], 3))
    assert np.allclose(some @ some.T, np.eye(3)) and np.allclose(some[:, 3:], 0)


def test_products_beyond_doubles_are_exact():
    x = np.array([[1 << 39, 3], [-(1 << 38), (1 << 40) - 1]])
    wide = x.astype(object)
    assert (w.exact_product(x) == wide.T @ wide).all()
    small = np.arange(12).reshape(4, 3)
    assert (w.exact_product(small) == small.T @ small).all()

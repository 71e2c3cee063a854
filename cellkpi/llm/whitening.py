"""Whitening of embeddings from the exact characteristic polynomial of their scatter.

Components are scaled to whole numbers. With each distinct vector x counted once, n of them with sums
S, the scatter M = n * sum(x x^T) - S S^T is an integer matrix, n^2 times the covariance. Tasks add up
their part of it exactly and Spark adds the parts as decimals. The polynomial of M is found modulo
many primes, a few primes a task: each reduces M to Hessenberg form and reads the polynomial off its
subdiagonals. Chinese remaindering gives its exact integer coefficients.

All roots are real, so by Descartes' rule the sign changes of the polynomial shifted by a number are
exactly the roots above it, with multiplicity. Bisection by that count isolates each root, and by the
sign of the polynomial once it stands alone, to 2^-BITS of the largest. Components then come from
inverse iteration on the null space of M - root, eliminated with many digits. Roots that agree to that
width are taken as one, and any orthonormal basis of their space serves.

What reaches the driver is the scatter and the polynomial: their size goes with the dimension, not
with the rows. All rows are whitened by the same components, of which the largest entry is positive.

Rows whose vector is null, or holds null or non-finite entries, are left out; a null id is kept, and
repeated rows give repeated rows though the fit counts their vector once. Vectors of different lengths
are whitened apart. Where a component has no variance (a single vector, or more components than the
rank), ``whitened`` is null; without any variance ``explained`` and ``identity_error`` are null too.
Vectors without entries, and empty tables, give no rows. An entry beyond 2^40 after scaling raises.
Columns besides the id and the vector are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellkpi.llm.common import discard, stored

COMPONENTS, SCALE = 4, 256
BITS = 200  # roots are known to this many bits below the largest one
DIGITS = 110  # of the elimination; 2^-BITS and the conditioning of two steps fit into them
PRIMES_A_TASK = 16
LARGEST = 1 << 40
EXACT = 1 << 53
ENTRIES = 1 << 22  # of a batch that is worked on at a time


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are numbers."""

    def sound(x: Column) -> Column:
        value = x.cast("double")
        return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))

    return F.coalesce(F.forall(vector, sound), F.lit(False))


def scaled_entries(vector: Column, scale: int, largest: int) -> Column:
    """floor(scale * c) of each component as a long; beyond ``largest`` an error."""

    def entry(x: Column) -> Column:
        value = F.floor(F.lit(float(scale)) * x.cast("double"))
        complaint = F.raise_error(F.concat(F.lit("too large to scale: "), x.cast("string")))
        wide = F.abs(F.lit(float(scale)) * x.cast("double")) > F.lit(float(largest))
        return F.when(wide, complaint.cast("long")).otherwise(value)

    return F.transform(vector, entry)


def _matrices(batches: Iterable[pa.RecordBatch], column: int, size: int) -> Iterator[tuple]:
    """Parts of batches and their vectors as integer matrices."""
    step = max(1, ENTRIES // size)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(column).flatten().to_numpy().reshape(-1, size)


def exact_product(x: np.ndarray) -> np.ndarray:
    """x^T x of an integer matrix as Python integers."""
    most = int(np.abs(x).max(initial=0))
    rows = EXACT // max(1, most * most)
    if rows < 1:
        wide = x.astype(object)
        return wide.T @ wide
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), rows):  # within doubles that hold every sum exactly
        part = x[at : at + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def scatter(fit: DataFrame, size: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, n * sum(x x^T) - S S^T) of the distinct vectors ``x``."""
    upper = np.triu_indices(size)

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(size, object), np.zeros((size, size), object)
        for _, x in _matrices(batches, 0, size):
            n += len(x)
            sums = sums + x.sum(axis=0).astype(object)
            squares = squares + exact_product(x)
        if n:
            values = [n, *sums, *squares[upper]]
            yield pa.record_batch(
                [pa.array(range(len(values)), pa.int32()), pa.array(map(Decimal, values), pa.decimal128(38))],
                ["place", "value"],
            )

    parts = fit.mapInArrow(part, "place int, value decimal(38,0)")
    rows = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
    whole = [int(v) for _, v in sorted((r.place, r.value) for r in rows)]
    n, sums = whole[0], whole[1 : size + 1]
    squares = np.zeros((size, size), object)
    squares[upper] = whole[size + 1 :]
    squares = np.triu(squares) + np.triu(squares, 1).T
    return n, sums, n * squares - np.outer(np.array(sums, object), np.array(sums, object))


def is_prime(n: int) -> bool:
    """Miller and Rabin's test; these bases decide every number below 3.2e14."""
    if n % 2 == 0:
        return n == 2
    odd = (n - 1) & -(n - 1)
    for base in (2, 3, 5, 7, 11, 13, 17):
        if n % base == 0:
            return n == base
        power = pow(base, (n - 1) // odd, n)
        if power in (1, n - 1):
            continue
        turns = odd.bit_length() - 2
        for _ in range(turns):
            power = power * power % n
            if power == n - 1:
                break
        else:
            return False
    return True


def primes_below(limit: int) -> Iterator[int]:
    return (n for n in range(limit - 1, 1, -1) if is_prime(n))


def coefficient_bound(trace: int, size: int) -> int:
    """No coefficient exceeds this: roots are not negative and sum to the trace (Maclaurin)."""
    return max(comb(size, k) * (trace**k // size**k + 1) for k in range(size + 1))


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a^(p-2) modulo p, the inverse; zero for zero."""
    out, power = np.ones_like(a), a % p
    for bit in range(31):
        out = np.where((p - 2) >> bit & 1, out * power % p, out)
        power = power * power % p
    return out


def polynomials(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """The characteristic polynomial of an integer matrix modulo each prime below 2^31.

    A row per prime, coefficients from the constant term up. Entries are reduced after every product
    so that 64 bits hold them.
    """
    size, many = len(matrix), len(primes)
    p = np.array(primes, np.int64)
    p2, p3 = p[:, None], p[:, None, None]
    h = np.stack([(matrix % q).astype(np.int64) for q in primes])
    each = np.arange(many)
    for k in range(size - 2):
        pivot = k + 1 + np.argmax(h[:, k + 1 :, k] != 0, axis=1)
        rows = h[each, pivot].copy()
        h[each, pivot], h[:, k + 1] = h[:, k + 1].copy(), rows
        columns = h[each, :, pivot].copy()
        h[each, :, pivot], h[:, :, k + 1] = h[:, :, k + 1].copy(), columns
        factor = h[:, k + 2 :, k] * _inverse(h[:, k + 1, k], p)[:, None] % p2
        h[:, k + 2 :] = (h[:, k + 2 :] - factor[:, :, None] * h[:, None, k + 1] % p3) % p3
        back = (h[:, :, k + 2 :] * factor[:, None, :] % p3).sum(axis=2)
        h[:, :, k + 1] = (h[:, :, k + 1] + back) % p2
    found = [np.zeros((many, size + 1), np.int64)]
    found[0][:, 0] = 1
    for k in range(size):
        now = np.zeros((many, size + 1), np.int64)
        now[:, 1:] = found[k][:, :-1]
        now = (now - h[:, k, k, None] * found[k] % p2) % p2
        chain = np.ones(many, np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * h[:, i + 1, i] % p
            now = (now - (h[:, i, k] * chain % p)[:, None] * found[i] % p2) % p2
        found.append(now)
    return found[size]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients, from the constant term up, of a positive semidefinite integer matrix."""
    size = len(matrix)
    needed = 2 * coefficient_bound(int(np.trace(matrix)), size) + 1
    primes: list[int] = []
    modulus, source = 1, primes_below(1 << 31)
    while modulus <= needed:
        primes.append(next(source))
        modulus *= primes[-1]

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = batch.column(0).to_pylist()
            for at in range(0, len(taken), PRIMES_A_TASK):
                some = [primes[i] for i in taken[at : at + PRIMES_A_TASK]]
                rows = [r.tolist() for r in polynomials(matrix, some)]
                yield pa.record_batch([pa.array(some), pa.array(rows)], ["prime", "residues"])

    tasks = -(-len(primes) // PRIMES_A_TASK)
    numbers = spark.range(0, len(primes), numPartitions=tasks)
    rows = numbers.mapInArrow(reduce, "prime long, residues array<long>").collect()
    values, done = [0] * (size + 1), 1
    for prime, residues in rows:
        back = pow(done, -1, prime)
        values = [v + done * ((r - v) * back % prime) for v, r in zip(values, residues, strict=True)]
        done *= prime
    return [v - done if 2 * v > done else v for v in values]


@dataclass(frozen=True)
class Root:
    """A root between low / 2^scale and high / 2^scale, and how many roots lie there."""

    low: int
    high: int
    scale: int
    count: int

    def middle(self) -> Decimal:
        return Decimal(self.low + self.high) / (Decimal(2) ** (self.scale + 1))


def roots_above(polynomial: list[int], at: int, scale: int) -> int:
    """How many roots, with multiplicity, exceed at / 2^scale; all roots have to be real."""
    degree = len(polynomial) - 1
    c = [v << (scale * (degree - i)) for i, v in enumerate(polynomial)]
    for i in range(degree):
        for j in range(degree - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(polynomial: list[int], at: int, scale: int) -> int:
    value, unit = 0, 1
    for c in reversed(polynomial):
        value = value * at + c * unit
        unit <<= scale
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], wanted: int) -> list[Root]:
    """The ``wanted`` largest positive roots of a polynomial with real roots only, falling."""
    degree = len(polynomial) - 1
    top = 1 << max(1, (-polynomial[degree - 1]).bit_length())  # above the trace
    positive = roots_above(polynomial, 0, 0)
    scale = None
    found: list[Root] = []
    for number in range(1, min(wanted, positive) + 1):
        if found and found[-1].count > 0 and number <= sum(r.count for r in dict.fromkeys(found)):
            found.append(found[-1])  # another of the roots that can't be told apart
            continue
        low, high, at_low, at_high, now = 0, top, positive, 0, 0
        target = scale if scale is not None else 0
        while now <= target:
            while high - low > 1:
                middle = (low + high) // 2
                if at_low - at_high == 1 and (sign := _sign(polynomial, middle, now)):
                    # alone in (low, high]: it lies above the middle if the sign changes after it
                    above = at_high if sign == _sign(polynomial, high, now) else at_low
                else:
                    above = roots_above(polynomial, middle, now)
                if above >= number:
                    low, at_low = middle, above
                else:
                    high, at_high = middle, above
            if scale is None:
                target = scale = max(0, BITS - high.bit_length())
            if now == target:
                break
            low, high, now = low << (target - now), high << (target - now), target
        found.append(Root(low, high, now, at_low - at_high))
    return found


def null_vectors(matrix: np.ndarray, root: Root, wanted: int) -> list[np.ndarray]:
    """Orthonormal vectors of the null space of matrix - root, by inverse iteration."""
    size = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS + len(str(abs(int(np.trace(matrix)))))
        lower = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
        lower[np.diag_indices(size)] -= root.middle()
        least = max(map(abs, lower.ravel())) * Decimal(10) ** (-DIGITS + 5)
        order = np.arange(size)
        for k in range(size):
            pivot = k + max(range(size - k), key=lambda i: abs(lower[k + i, k]))
            lower[[k, pivot]], order[[k, pivot]] = lower[[pivot, k]], order[[pivot, k]]
            if abs(lower[k, k]) < least:
                lower[k, k] = least
            lower[k + 1 :, k] /= lower[k, k]
            lower[k + 1 :, k + 1 :] -= np.outer(lower[k + 1 :, k], lower[k, k + 1 :])

        def solve(right: np.ndarray) -> np.ndarray:
            x = right[order].copy()
            for k in range(size):
                x[k + 1 :] -= lower[k + 1 :, k] * x[k]
            for k in range(size - 1, -1, -1):
                x[k] /= lower[k, k]
                x[:k] -= lower[:k, k] * x[k]
            return x

        def unit(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
            x = x / max(map(abs, x))
            for _ in range(2):
                for other in others:
                    x = x - other * (x @ other)
            return x / (x @ x).sqrt()

        found: list[np.ndarray] = []
        starts = np.random.default_rng(size).integers(1, 1000, (wanted, size))
        for start in starts:
            x = unit(np.array([Decimal(int(v)) for v in start], object), found)
            for _ in range(3):
                x = unit(solve(x), found)
            found.append(x)
        out = [np.array([float(v) for v in x]) for x in found]
    return [x if x[np.argmax(np.abs(x))] > 0 else -x for x in out]


@dataclass(frozen=True)
class Components:
    """What whitens vectors: n, S, unit components, the scatter's roots, shares of the variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # a row per component that has variance
    roots: list[float]
    explained: list[float | None]


def principal_components(fit: DataFrame, size: int, wanted: int) -> Components:
    """Components of the distinct vectors in the only column of ``fit``."""
    n, sums, matrix = scatter(fit, size)
    trace = int(np.trace(matrix))
    if not trace:
        return Components(n, sums, np.zeros((0, size)), [], [None] * wanted)
    polynomial = characteristic_polynomial(fit.sparkSession, matrix)
    roots = largest_roots(polynomial, wanted)
    vectors: list[np.ndarray] = []
    for root in dict.fromkeys(roots):
        vectors += null_vectors(matrix, root, roots.count(root))
    with localcontext() as context:
        context.prec = DIGITS
        values = [float(r.middle()) for r in roots]
        explained = [float(r.middle() / trace) for r in roots]
    return Components(
        n, sums, np.array(vectors), values, explained + [0.0] * (wanted - len(roots))
    )


def _centred(x: np.ndarray, found: Components) -> np.ndarray:
    """n * x - S, exact."""
    most = int(np.abs(x).max(initial=0))
    if found.n * most + max(map(abs, found.sums)) < 1 << 62:
        return x * found.n - np.array(found.sums, np.int64)
    return x.astype(object) * found.n - np.array(found.sums, object)


def _whitened(centred: np.ndarray, found: Components) -> np.ndarray:
    return centred.astype(np.float64) @ found.vectors.T / np.sqrt(found.roots)


def identity_error(fit: DataFrame, size: int, found: Components) -> float | None:
    """How far the covariance of the whitened fit is from the identity, at most."""
    many = len(found.roots)
    if not many:
        return None

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many * (many + 1))
        for _, x in _matrices(batches, 0, size):
            w = _whitened(_centred(x, found), found)
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        places = pa.array(range(len(total)), pa.int32())
        yield pa.record_batch([places, pa.array(total)], ["place", "value"])

    parts = fit.mapInArrow(part, "place int, value double")
    rows = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.array([v for _, v in sorted((r.place, r.value) for r in rows)]) / found.n
    mean, squares = total[:many], total[many:].reshape(many, many)
    return float(np.abs(squares - np.outer(mean, mean) - np.eye(many)).max())


def _rows(points: DataFrame, size: int, found: Components, error: float | None) -> DataFrame:
    """A row per vector and component."""
    kind = points.schema["id"].dataType.simpleString()
    wanted, many = min(size, len(found.explained)), len(found.roots)
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, 1, size):
            centred = _centred(x, found)
            most = int(np.abs(centred).max(initial=0))
            wide = centred if most * most * size < 1 << 62 else centred.astype(object)
            deviation = pa.array(map(Decimal, (wide * wide).sum(axis=1).tolist()), pa.decimal128(38))
            values = np.full((len(x), wanted), np.nan)
            values[:, :many] = _whitened(centred, found)
            row = pa.array(np.repeat(np.arange(len(x)), wanted))
            number = np.tile(np.arange(wanted), len(x))
            yield pa.record_batch(
                [
                    part.column(0).take(row),
                    pa.array((number + 1).astype(np.int32)),
                    pa.array(np.full(len(row), found.n)),
                    deviation.take(row),
                    pa.array(values.ravel(), mask=number >= many),
                    pa.array(found.explained, pa.float64()).take(pa.array(number)),
                    pa.array([error] * len(row), pa.float64()),
                ],
                names,
            )

    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double"
    return points.mapInArrow(place, f"{schema}, explained double, identity_error double")


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    vector = F.col(vector_column)
    sound = vectors.where(finite(vector) & (F.size(vector) > 0))
    points = stored(
        sound.select(
            F.col(id_column).alias("id"), scaled_entries(vector, scale, LARGEST).alias("x")
        ),
        "points",
    )
    sizes = sorted(r[0] for r in points.select(F.size("x")).distinct().collect())
    out = []
    for size in sizes:  # the lengths of embeddings in use, as a rule one
        some = points.where(F.size("x") == size)
        fit = stored(some.select("x").distinct(), "fit")
        found = principal_components(fit, size, min(size, components))
        error = identity_error(fit, size, found)
        discard(fit)
        out.append(_rows(some, size, found, error))
    if not out:
        schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double"
        return spark.createDataFrame([], f"{schema}, explained double, identity_error double")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionAll(more)
    return whole


def whitening_query(embeddings: DataFrame) -> DataFrame:
    """Four components of each vector; a deviation that no long holds raises."""
    found = whiten(embeddings).withColumnRenamed("id", "vec_id")
    return found.withColumn("deviation", F.col("deviation").cast("long"))

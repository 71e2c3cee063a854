"""Hard negatives by exact inner products in a residue number system.

Vectors are whole numbers. An anchor's positives are the rows of its label with the largest inner
products; its hard negatives are rows of other labels whose product lies in a window below a positive's.

Products are matrix products modulo several small primes in single precision. Components are reduced to
residues around zero, and primes are as large as keeps a sum of their products, over a slice of
components, below 2^24, where float32 is exact. Longer vectors add up slices modulo the prime. As many
primes are taken as the largest squared length needs, which bounds every product, and mixed-radix Chinese
remaindering gives the signed scores as longs.

Anchors and rows are dealt into blocks by a hash of the row, and each pair of blocks is a task's work,
whatever labels are in it, so that no label, vector or anchor is a hot key. A block pair sends the best
few per anchor, or per anchor and positive, and a window over those picks the result. Two passes: the
negatives' windows follow from the positives found first.

Rows with a null id, null label, null vector, or a null or non-finite component take no part. Vectors
are compared with those of their own length. Rows are told apart as rows: an anchor that is repeated is
its copy's first positive, and gives its results again. Equal scores go by the smaller id. Anchors
without positives, positives without rows in their window, and empty tables give no rows; the window of
a negative score is empty. Products that no long holds raise. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellkpi.llm.common import grouped_chunks, stored
from cellkpi.llm.whitening import finite, is_prime, scaled_entries

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
ANCHOR_STEP = 100
ANCHORS, ROWS = 16_384, 8_192  # of a block
SLICE = 1024  # components that are added before a reduction
TILE = 1 << 21  # scores held at a time
LARGEST = 1 << 62
NONE = np.iinfo(np.int64).min


def residue_primes(size: int, largest: int) -> list[int]:
    """Odd primes whose residue products add up exactly, enough of them for scores to ``largest``."""
    half = isqrt((1 << 24) // max(1, min(size, SLICE)))
    primes: list[int] = []
    modulus, p = 1, 2 * half + 1
    while modulus <= 2 * largest + 1:
        if p < 3:
            raise ValueError("too few primes for vectors as long as these")
        if is_prime(p):
            primes.append(p)
            modulus *= p
        p -= 2
    return primes


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2."""
    return (x + p // 2) % p - p // 2


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [centred(x, p).astype(np.float32) for p in primes]


def modular_products(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a b^T modulo p, around zero; of residues around zero."""
    total = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], SLICE):
        total += (a[:, at : at + SLICE] @ b[:, at : at + SLICE].T).astype(np.int64)
    return centred(total, p)


def exact_scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed inner products of rows whose residues are given, by mixed-radix digits around zero."""
    digits: list[np.ndarray] = []
    score, weight = np.zeros((len(a[0]), len(b[0])), np.int64), 1
    for i, p in enumerate(primes):
        digit = modular_products(a[i], b[i], p)
        for before, q in zip(digits, primes, strict=False):
            digit = centred((digit - before) * pow(q, -1, p), p)
        digits.append(digit)
        # Digits past the score's size are zero. One whose weight no long holds is not added.
        if weight < LARGEST:
            score = score + digit * weight
        weight *= p
    return score


def best(scores: np.ndarray, allowed: np.ndarray, some: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``some`` largest allowed scores of each row; ties to the first column."""
    masked = np.where(allowed, scores, NONE)
    many = masked.shape[1]
    if many > some:
        bound = np.partition(masked, many - some, axis=1)[:, many - some]
        near = (masked >= bound[:, None]) & allowed
    else:
        near = allowed
    row, column = np.nonzero(near)
    order = np.lexsort((column, -masked[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < some], column[place < some]


def _paired(base: DataFrame, anchors: DataFrame, rows: int, some: int) -> DataFrame:
    """All rows of each pair of blocks together, rows before anchors, by id."""
    n = lambda count, of: max(1, -(-count // of))
    bases, asks = n(base.count(), rows), n(anchors.count(), some)
    salt = lambda many: F.pmod(F.xxhash64("row"), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    base = base.withColumn("b", salt(bases)).withColumn("a", each(asks))
    asked = anchors.withColumn("a", salt(asks)).withColumn("b", each(bases))
    if "wanted" not in anchors.columns:
        asked = asked.withColumn("wanted", F.lit(None).cast("array<long>"))
    columns = ["size", "a", "b", "row", "id", "label", "x", "wanted"]
    cell = F.xxhash64("size", "a", "b").alias("cell")
    base = base.withColumn("wanted", F.lit(None).cast("array<long>"))
    both = base.select(cell, *columns, F.lit(0).alias("side")).unionAll(
        asked.select(cell, *columns, F.lit(1).alias("side"))
    )
    return both.repartition("cell").sortWithinPartitions("cell", "size", "a", "b", "side", "id", "row")


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(rows, anchors) of each pair of blocks that has both."""
    for chunk in grouped_chunks(batches, "cell", 4096):
        name = np.stack([chunk.column(c).to_numpy() for c in ("size", "a", "b")], axis=1)
        cuts = np.flatnonzero((name[1:] != name[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), chunk.num_rows]
        side = chunk.column("side").to_numpy()
        for b, e in zip(bounds, bounds[1:], strict=False):
            middle = b + int(np.searchsorted(side[b:e], 1))
            if middle not in (b, e):
                yield (
                    chunk.slice(b, middle - b).combine_chunks(),
                    chunk.slice(middle, e - middle).combine_chunks(),
                )


def _matrix(part: pa.Table) -> np.ndarray:
    return part.column("x").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)


def _tiles(batches: Iterable[pa.RecordBatch], largest: int) -> Iterator[tuple]:
    """(rows, some anchors, their scores) with as many scores at a time as a tile holds."""
    for base, asked in _cells(batches):
        x, y = _matrix(base), _matrix(asked)
        primes = residue_primes(x.shape[1], largest)
        right = residues(x, primes)
        step = max(1, TILE // len(x))
        for at in range(0, len(y), step):
            left = residues(y[at : at + step], primes)
            yield base, asked.slice(at, step), exact_scores(left, right, primes)


def _find_positives(largest: int, some: int) -> Callable:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, asked, scores in _tiles(batches, largest):
            own, labels = asked.column("row").to_numpy(), asked.column("label").to_numpy()
            same = labels[:, None] == base.column("label").to_numpy()
            same &= own[:, None] != base.column("row").to_numpy()
            row, column = best(scores, same, some)
            taken = pa.array(column)
            yield pa.record_batch(
                [pa.array(own[row]), *(base.column(c).take(taken).combine_chunks() for c in ("row", "id")),
                 pa.array(scores[row, column])],
                ["row", "other", "positive_id", "positive_score"],
            )

    return find


def _find_negatives(largest: int, some: int, low: int, high: int) -> Callable:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, asked, scores in _tiles(batches, largest):
            own, labels = asked.column("row").to_numpy(), asked.column("label").to_numpy()
            other = labels[:, None] != base.column("label").to_numpy()
            wanted = asked.column("wanted").to_pylist()
            for slot in range(max(map(len, wanted))):
                at = np.array([i for i, w in enumerate(wanted) if slot < len(w)])
                score = [wanted[i][slot] for i in at]
                # 100 * negative between low * positive and high * positive, without large products
                least = np.array([-(-low * p // 100) for p in score])[:, None]
                most = np.array([high * p // 100 for p in score])[:, None]
                part = scores[at]
                row, column = best(part, other[at] & (part >= least) & (part <= most), some)
                taken = pa.array(column)
                yield pa.record_batch(
                    [pa.array(own[at][row]), pa.array(np.full(len(row), slot, np.int32)),
                     *(base.column(c).take(taken).combine_chunks() for c in ("row", "id")),
                     pa.array(part[row, column])],
                    ["row", "slot", "other", "negative_id", "negative_score"],
                )

    return find


def prepared(
    vectors: DataFrame, scale: int, id_column: str, label_column: str, vector_column: str
) -> DataFrame:
    """(row, id, label, size, x) of the rows that take part, stored."""
    vector, label = F.col(vector_column), F.col(label_column)
    sound = vectors.where(F.col(id_column).isNotNull() & label.isNotNull() & finite(vector))
    whole = sound.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("id"),
        label.cast("long").alias("label"),
        F.size(vector).alias("size"),
        scaled_entries(vector, scale, LARGEST).alias("x"),
    )
    return stored(whole, "vectors")


def largest_score(rows: DataFrame) -> int:
    """A bound on all inner products: the largest squared length, rounded up."""
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    most = rows.agg(F.max(square)).first()[0] or 0.0
    bound = int(most * (1 + 1e-9)) + 1
    if bound >= LARGEST:
        raise ValueError(f"inner products of up to {bound} do not fit into a long")
    return bound


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    anchor_block: int = ANCHORS,
    row_block: int = ROWS,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``, the id of a row; ``low`` and ``high`` are percent of a
    positive's score.
    """
    rows = prepared(vectors, scale, id_column, label_column, vector_column)
    kind = rows.schema["id"].dataType.simpleString()
    largest = largest_score(rows)
    anchors = rows.where(is_anchor)
    near = _paired(rows, anchors, row_block, anchor_block).mapInArrow(
        _find_positives(largest, positives),
        f"row long, other long, positive_id {kind}, positive_score long",
    )
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "other")
    near = near.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < positives)
    near = stored(near.drop("other"), "positives")

    scores = F.array_sort(F.collect_list(F.struct("slot", "positive_score")))
    wanted = near.groupBy("row").agg(F.transform(scores, lambda s: s.positive_score).alias("wanted"))
    asked = stored(anchors.join(wanted, "row"), "anchors")
    found = _paired(rows, asked, row_block, anchor_block).mapInArrow(
        _find_negatives(largest, negatives, low, high),
        f"row long, slot int, other long, negative_id {kind}, negative_score long",
    )
    order = Window.partitionBy("row", "slot").orderBy(F.desc("negative_score"), "negative_id", "other")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = found.join(near, ["row", "slot"]).join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def hard_negative_query(embeddings: DataFrame) -> DataFrame:
    """Ten negatives in the window of each of five positives of every vector whose id ends in 00."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    labelled = embeddings.select("vec_id", "embedding", turned.alias("label"))
    return hard_negatives(labelled, F.col("id") % ANCHOR_STEP == 0)

"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns a unit vector by a fast pseudo-rotation (three rounds of sign flips and a Hadamard
transform) and names the nearest signed axis among the first ``AXES`` of the turned space, so that wide
vectors get no more buckets than narrow ones. Every vector is indexed under its axis in each of several
tables, more of them for wide vectors; a query looks under its ``probes`` nearest axes in each. Base
vectors and queries that meet are scored exactly in double precision and only a query's best few leave
the task. Queries that met fewer vectors than asked for are held against all vectors, in blocks.

Equal vectors are one entry that carries their smallest ids, as many as a query can need, so a
vector that fills a third of the table is indexed once. An axis under which many vectors or queries
lie is split into blocks of both; each block of queries meets each block of vectors in a task of
bounded size. All vectors are indexed. The README gives the recall by dimension and size.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids.
Vectors are compared with those of their own length only. Rows that repeat an id with another vector
count as one id with several vectors, and their best score counts. Columns besides the id and the
vector are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellkpi.llm.common import discard, grouped_chunks, stored

PROBES, BLOCK, SEED = 12, 4096, 7
AXES = 64  # of a turned vector that are looked at; twice as many buckets
TABLES, TABLES_A_DOUBLING = 24, 4  # up to AXES dimensions, and more for every doubling of them
NEAREST, QUERY_STEP = 5, 50
MORE = 3  # entries sent beyond those needed, for scores that rounding puts in another order


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of the rows, whose length is a power of two."""
    n, size = x.shape
    step = 1
    while step < size:
        pairs = x.reshape(n, -1, 2, step)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        x = np.stack([a + b, a - b], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


@lru_cache(maxsize=16)
def signs(size: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).choice([-1.0, 1.0], (tables, 3, size))


def tables_for(size: int) -> int:
    """How many tables vectors of ``size`` dimensions are indexed in."""
    return TABLES + TABLES_A_DOUBLING * max(0, (-(-size // AXES) - 1).bit_length())


def rotations(unit: np.ndarray, tables: int, seed: int) -> Iterator[np.ndarray]:
    """The vectors turned for each table, padded to a power of two."""
    size = 1 << max(0, unit.shape[1] - 1).bit_length()
    padded = np.zeros((len(unit), size))
    padded[:, : unit.shape[1]] = unit
    for rounds in signs(size, tables, seed):
        x = padded
        for flip in rounds:
            x = hadamard(x * flip)
        yield x


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Doubles whose largest component lies in [0.5, 1), by an exact power of two per row."""
    wide = vectors.astype(np.float64)
    _, power = np.frexp(np.abs(wide).max(axis=1, initial=0))
    return np.ldexp(wide, -power[:, None])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, summed in one order for all; of scaled vectors."""
    norms = np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1))
    return (a * b).sum(axis=-1) / norms


def _usable(vector: Column) -> Column:
    def sound(x: Column) -> Column:
        value = x.cast("double")
        finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
        return F.coalesce(finite, F.lit(False))

    some = F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False)))
    return vector.isNotNull() & F.forall(vector, sound) & some


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch, vector: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with vectors of one length, and their matrices."""
    sizes = np.diff(batch.column(vector).offsets.to_numpy())
    for size in np.unique(sizes):
        part = batch.take(pa.array(np.flatnonzero(sizes == size)))
        yield part, _matrix(part.column(vector))


def hashed(vectors: DataFrame, tables: int | None, probes: int, seed: int) -> DataFrame:
    """``vectors`` (ids, vector) with a row per table and probe: size, table, axis."""
    names = ["size", "slot", "axis", "ids", "vector"]
    kinds = dict(vectors.dtypes)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                for batch, matrix in _by_size(whole.slice(at, 1024), 1):
                    yield from axes(batch, matrix)

    def axes(batch: pa.RecordBatch, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        scale = scaled(matrix)
        unit = scale / np.sqrt((scale * scale).sum(axis=1))[:, None]
        n, size = matrix.shape
        many = tables_for(size) if tables is None else tables
        for slot, turned in enumerate(rotations(unit, many, seed)):
            turned = turned[:, :AXES]
            signed = np.concatenate([turned, -turned], axis=1)
            some = min(probes, signed.shape[1])
            nearest = np.argpartition(-signed, some - 1, axis=1)[:, :some].ravel()
            row = pa.array(np.repeat(np.arange(n), some))
            fixed = [np.full(len(row), x, np.int32) for x in (size, slot)]
            columns = [*map(pa.array, fixed), pa.array(nearest.astype(np.int32))]
            columns += [batch.column(0).take(row), batch.column(1).take(row)]
            yield pa.record_batch(columns, names)

    schema = f"size int, slot int, axis int, ids {kinds['ids']}, vector {kinds['vector']}"
    return vectors.mapInArrow(place, schema)


def search_group(
    queries: np.ndarray, query_ids: list, base: np.ndarray, base_ids: list[list], nearest: int
) -> Iterator[tuple]:
    """(query id, id, score) of the best entries of ``base`` for each query."""
    base = scaled(base)
    unit = base / np.sqrt((base * base).sum(axis=1))[:, None]
    least = np.array([ids[0] for ids in base_ids])
    some = min(nearest + MORE, len(base))
    for at in range(0, len(queries), 1024):
        part = scaled(queries[at : at + 1024])
        rough = np.round(part @ unit.T / np.sqrt((part * part).sum(axis=1))[:, None], 12)
        for i, row in enumerate(rough):
            own = query_ids[at + i]
            bound = np.partition(row, len(row) - some)[len(row) - some]
            good = np.flatnonzero(row >= bound)
            good = good[np.lexsort((least[good], -row[good]))][:some]
            for j, score in zip(good, cosine(part[i], base[good]).tolist(), strict=True):
                yield from ((own, x, score) for x in base_ids[j] if x != own)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    nearest: int = NEAREST,
    tables: int | None = None,
    probes: int = PROBES,
    block: int = BLOCK,
    seed: int = SEED,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``nearest`` other vectors found for each query: (query_id, rank, vec_id, score).

    ``is_query`` is a condition on ``id``, the id of a row. Ranks go by cosine, ties by id.
    """
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("vector"))).distinct()
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    least = rows.withColumn("place", first).where(F.col("place") <= nearest + 1)
    base = least.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    base = stored(base.select("ids", "vector"), "vectors")
    asked = stored(rows.where(is_query).select(F.array("id").alias("ids"), "vector"), "queries")

    filed = stored(hashed(base, tables, 1, seed), "base")
    sought = stored(hashed(asked, tables, probes, seed), "asked")
    ranked = stored(_ranked(_met(filed, sought, nearest, block), nearest), "ranked")
    discard(filed)
    discard(sought)
    enough = ranked.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") == nearest)
    short = asked.join(enough, F.col("ids")[0] == F.col("query_id"), "left_anti")
    short = stored(short, "short")
    whole = lambda df: df.select(
        F.size("vector").alias("size"), F.lit(0).alias("slot"), F.lit(0).alias("axis"), "ids", "vector"
    )
    more = _met(whole(base), whole(short), nearest, block)
    return _ranked(ranked.select(*more.columns).unionAll(more), nearest)


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    """The ``nearest`` ids of each query, by their best score."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _met(base: DataFrame, asked: DataFrame, nearest: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each block of vectors for the queries that meet it."""
    kind = base.schema["ids"].dataType.elementType.simpleString()
    # One row per table and axis: as many as tables and dimensions make, however large the input.
    key = ["size", "slot", "axis"]
    parts = lambda df, name: df.groupBy(key).agg(
        F.ceil(F.count("*") / block).cast("int").alias(name)
    )
    grid = stored(parts(base, "bases").join(parts(asked, "asks"), key), "grid")
    salt = lambda n: F.pmod(F.xxhash64("ids", "vector"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = base.join(grid, key).withColumn("b", salt("bases")).withColumn("q", each("asks"))
    asked = asked.join(grid, key).withColumn("q", salt("asks")).withColumn("b", each("bases"))
    columns = [F.xxhash64(*key, "b", "q").alias("cell"), *key, "b", "q", "ids", "vector"]
    both = base.select(*columns, F.lit(0).alias("asks")).unionAll(
        asked.select(*columns, F.lit(1).alias("asks"))
    )
    both = both.repartition("cell").sortWithinPartitions("cell", *key, "b", "q", "asks")
    return both.mapInArrow(_search(nearest), f"query_id {kind}, vec_id {kind}, score double")


def _search(nearest: int) -> Callable:
    """The task that scores all queries of each cell against all vectors of it."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in grouped_chunks(batches, "cell", 4096):
            places = [chunk.column(c).to_numpy() for c in ("size", "slot", "axis", "b", "q")]
            name = np.stack(places, axis=1)
            cuts = np.flatnonzero((name[1:] != name[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), chunk.num_rows]
            asks = chunk.column("asks").to_numpy()
            out: list[tuple] = []
            for b, e in zip(bounds, bounds[1:], strict=False):
                middle = b + int(np.searchsorted(asks[b:e], 1))
                if middle in (b, e):
                    continue
                parts = [chunk.slice(x, y - x).combine_chunks() for x, y in ((b, middle), (middle, e))]
                ids = [p.column("ids").to_pylist() for p in parts]
                base, queries = (_matrix(p.column("vector").combine_chunks()) for p in parts)
                own = [x[0] for x in ids[1]]
                out += search_group(queries, own, base, ids[0], nearest)
            if out:
                yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))), ["query_id", "vec_id", "score"])

    return search


def neighbours_query(embeddings: DataFrame) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    found = nearest_neighbours(embeddings, F.col("id") % QUERY_STEP == 0)
    return found.withColumn("rank", F.col("rank").cast("int"))

"""Near duplicates by SimHash fingerprints, joined on a grid of per-segment bit counts.

A fingerprint is cut into 32 segments of two bits and mapped to the point of their bit counts. The
Manhattan distance of two points is at most the number of differing bits, so fingerprints within
``most_bits`` have points within it. Segments are put into ``groups`` groups; points that near agree
wholly in all but ``most_bits`` groups. Cells of the grid are the counts of each such choice of
groups: points in one cell are range-joined in the order of their total count, only while the totals are
within the bound (the Manhattan distance of the coarsest embedding). Pairs within the bound by the Manhattan
distance of their points are verified by the differing bits. Every choice is a cell, so no link is missed.

Only distinct fingerprints are joined. A cell gives a forest of its links, not all pairs. A cell with
more than ``hot`` fingerprints would be a task too large: its fingerprints go by *midpoints* instead.
Two fingerprints within four bits share a third one within two of both; those that share one are
within four. So each writes its neighbours within two bits, and those that meet are linked to the
least, linear in the number of fingerprints.

With more fingerprints more groups make smaller cells: 6 groups give 15 cells per fingerprint of
about 15 bits of choice, 8 give 70 of about 22, which suits billions.

A null, empty or wordless text has the fingerprint zero, linked like any other. Rows with equal
fingerprints are linked. Nulls among ids are passed over when the least id is sought; a component of
null ids only has a null id. Columns besides the id and the text are ignored by ``near_duplicates``
and kept by ``drop_near_duplicates`` and ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellkpi.llm.common import grouped_chunks, numbered, sized_slices, stored
from cellkpi.llm.components import components

SHINGLE, SEED = 4, 42
MOST_BITS, GROUPS, HOT = 4, 6, 50_000
SEGMENTS, SEGMENT_BITS = 32, 2


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a text's shingles, repeats included; bit 0 is the lowest."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-size] + 1])
    digest = xxhash.xxh64_intdigest
    pairs = zip(begins.tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[b:e], SEED) for b, e in pairs], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    texts = documents.select(
        F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text")
    )
    kind = texts.schema["doc_id"].dataType.simpleString()

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, 1):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t) for t in texts], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return texts.mapInArrow(mark, f"doc_id {kind}, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def group_masks(groups: int) -> list[int]:
    """Masks of whole segments that split the 64 bits into groups of nearly one size."""
    cuts = [SEGMENTS * i // groups * SEGMENT_BITS for i in range(groups + 1)]
    return [(1 << e) - (1 << b) for b, e in zip(cuts, cuts[1:], strict=False)]


def segment_counts(fp: Column) -> Column:
    """The bit counts of all segments, each in the two bits of its segment."""
    even = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def cells(points: DataFrame, most_bits: int, groups: int) -> DataFrame:
    """(choice, cell, fp): the cells of each fingerprint, one per choice of groups that agree."""
    masks = group_masks(groups)
    choices = [
        _signed(sum(masks[i] for i in chosen))
        for chosen in combinations(range(groups), groups - most_bits)
    ]
    every = F.array(*(F.col("counts").bitwiseAND(F.lit(mask)) for mask in choices))
    return points.withColumn("counts", segment_counts(F.col("fp"))).select(
        F.posexplode(every).alias("choice", "cell"), "fp"
    )


def sorted_segments(fp: np.ndarray) -> np.ndarray:
    """The bits of each segment sorted: differing bits of two are their points' Manhattan distance."""
    even = np.uint64(0x5555555555555555)
    one = np.uint64(1)
    low = (fp | fp >> one) & even  # at least one bit of the two
    return low | (fp & fp >> one & even) << one


def forest(cell: np.ndarray, fp: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, least fp joined to it) that connect what is within ``most_bits`` in each cell."""
    total = np.bitwise_count(fp)
    order = np.lexsort((total, cell))
    cell, fp, total = cell[order], fp[order], total[order].astype(np.int64)
    n = len(fp)
    point = sorted_segments(fp)
    label = np.arange(n)
    fresh = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    stop = np.repeat(fresh[1:], np.diff(fresh))
    live, off = np.arange(n), 1
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0
    while len(live):
        live = live[live + off < stop[live]]
        live = live[total[live + off] - total[live] <= most_bits]
        near = live[np.bitwise_count(point[live] ^ point[live + off]) <= most_bits]
        near = near[np.bitwise_count(fp[near] ^ fp[near + off]) <= most_bits]
        near = near[label[near] != label[near + off]]
        left.append(near)
        right.append(near + off)
        held += len(near)
        if held > 1 << 20:
            label = _joined(label, np.concatenate(left), np.concatenate(right))
            left, right, held = [], [], 0
        off += 1
    if left:
        label = _joined(label, np.concatenate(left), np.concatenate(right))
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def _joined(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (each place's root) after joining the places of the edges."""
    label = label.copy()
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right = left[apart], right[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def grid_links(points: DataFrame, most_bits: int, groups: int, hot: int) -> DataFrame:
    """(fp, low): links that connect all fingerprints within ``most_bits`` of each other."""
    grid = cells(points, most_bits, groups)
    # Written first: a join whose sides are both plain shuffles is split where a cell is dense.
    sizes = stored(grid.groupBy("choice", "cell").count().where("count > 1"), "sizes")
    shared = grid.join(sizes, ["choice", "cell"])

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in grouped_chunks(batches, "name"):
            fp = chunk.column("fp").to_numpy().view(np.uint64)
            pairs = forest(chunk.column("name").to_numpy(), fp, most_bits)
            yield pa.record_batch([pa.array(x.view(np.int64)) for x in pairs], ["fp", "low"])

    # A name may stand for two cells; that only adds comparisons.
    name = F.xxhash64("choice", "cell").alias("name")
    usual = shared.where(F.col("count") <= hot).select(name, "fp")
    usual = usual.repartition("name").sortWithinPartitions("name")
    links = usual.mapInArrow(link, "fp long, low long")
    dense = shared.where(F.col("count") > hot).select("fp").distinct()
    return links.unionAll(midpoint_links(dense, most_bits))


def midpoint_links(points: DataFrame, most_bits: int) -> DataFrame:
    """(fp, low) for fingerprints that share a neighbour within half of ``most_bits`` of both."""
    flips = [0]
    for size in range(1, (most_bits + 1) // 2 + 1):
        flips += [sum(1 << b for b in bits) for bits in combinations(range(64), size)]
    flips = np.array(flips, np.uint64)
    far = most_bits % 2 == 1  # then two that share a neighbour may be one bit too far apart

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 64):
                part = fps[at : at + 64]
                around = (part[:, None] ^ flips).ravel()
                own = np.repeat(part, len(flips))
                yield pa.record_batch(
                    [pa.array(x.view(np.int64)) for x in (around, own)], ["around", "fp"]
                )

    if far:
        raise ValueError("midpoints need an even number of bits")
    met = points.mapInArrow(spread, "around long, fp long")
    least = met.groupBy("around").agg(F.min("fp").alias("low"), F.count("*").alias("n"))
    links = met.join(least.where("n > 1"), "around").where("fp <> low")
    return links.select("fp", "low").distinct()


def near_duplicates(
    documents: DataFrame,
    most_bits: int = MOST_BITS,
    groups: int = GROUPS,
    hot: int = HOT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per document: its id, fingerprint and the least id of the documents it is linked to.

    Links are between fingerprints that differ in ``most_bits`` bits or fewer, directly or through
    others.
    """
    if not most_bits < groups <= SEGMENTS:
        raise ValueError("there must be more groups than differing bits, and 32 at most")
    marked = stored(fingerprints(documents, id_column, text_column), "fingerprints")
    points = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    points = stored(points, "points")
    links = stored(grid_links(points.select("fp"), most_bits, groups, hot), "links")
    roots = components(links).withColumnRenamed("node", "fp").withColumnRenamed("low", "root")
    rooted = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Written first, like the sizes: a root with very many fingerprints is split.
    named = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "named")
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(by_fp, "fp").select("doc_id", text, "component_id")


def drop_near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **limits: int
) -> DataFrame:
    """The documents with the least id of their component; all columns are kept.

    Rows with a null id are kept, for nothing tells which of them to keep. Rows that repeat an id
    are kept or dropped together.
    """
    found = near_duplicates(
        documents, id_column=id_column, text_column=text_column, **limits
    )
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_column)).distinct()
    return documents.join(gone, id_column, "left_anti").select(*documents.columns)


def one_of_each(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **limits: int
) -> DataFrame:
    """One row of each component, whatever its id; all columns are kept.

    It is the row with the least id; nulls come last, and rows of one id in the order of their
    texts' hashes. Only among equal ids and texts does a stored row number decide.
    """
    rows, row = numbered(documents)
    key = F.struct(
        F.col(id_column).isNull().alias("none"),
        F.col(id_column).alias("id"),
        F.xxhash64(text_column).alias("text"),
        F.col(row).alias("row"),
    )
    keyed = rows.select(key.alias("doc_id"), F.col(text_column).alias("text"))
    found = near_duplicates(keyed, **limits)
    gone = found.where("doc_id.row <> component_id.row").select(F.col("doc_id.row").alias(row))
    return rows.join(gone, row, "left_anti").select(*documents.columns)

"""Near copies by SimHash fingerprints of whole texts and of samples, verified on the shingles themselves.

Fingerprints of whole texts within four bits are found on the grid of segment counts, as for near duplicates in
general. But at a similarity of 0.8 over five-word shingles two fingerprints differ in some ten of 64 bits, where
no grid is selective: nearly every pair of documents would share a cell. So each text also gets a fingerprint
of each of several *samples*, the shingles with the lowest hashes under one seed of their own. Two texts of
similarity s have the same sample of r shingles, and so the same fingerprint, with chance s^r; texts of few
shingles get further, smaller samples. Texts that share a sample's fingerprint are compared by the fingerprints of the
whole: each names the nearest before it, if that is within ``FAR`` bits and their sizes allow the
similarity. A bucket gives at most one candidate per text (and block, in a bucket of several blocks), not all
pairs. Candidates are verified by the exact Jaccard similarity of their shingle sets; verified links make groups.

The nearest is only a quick way to most links. What it passes over is found exactly: where texts of a bucket are in
different groups yet, the bucket is compared again on the shingle sets themselves, all pairs of different groups whatever
their fingerprints. So are texts joined by whole fingerprints within four bits. A pair at the similarity shares one of
its rarest shingles of the bucket, about a fifth, so texts alike only in common passages are not compared one by one.
Two texts that share a sample, or whose fingerprints are within four bits, are thus linked whenever they have the similarity.

Texts with the same set of shingles are one class before anything is joined, so copies cost nothing further.
Buckets of over ``BLOCK`` classes are cut into blocks and all pairs of blocks are compared in tasks of their own: no
class is left out, and the work there is quadratic. A class that is the candidate of many is
split over tasks with a part of them each.

A null, empty or wordless text has no shingles; such texts are one class. Fewer words than a
shingle holds are one shingle. Only A to Z are folded to lower case. Repeated rows are copies, an empty table gives an
empty one, and columns besides the id and the text are kept, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellkpi.llm.common import TEXT_BYTES, discard, grouped_chunks, numbered, sized_slices, stored
from cellkpi.llm.components import components
from cellkpi.llm.simhash_dedup import GROUPS, HOT, MOST_BITS, grid_links

SHINGLE, SEED, SIMILARITY = 5, 42, 0.8
# (samples, shingles in each); the second kind only for texts of at most SHORT shingles
WIDE, NARROW, SHORT = (16, 6), (8, 2), 40
FAR = 20  # whole fingerprints at a similarity of 0.8 differ in 9.7 bits, with a deviation of 2.9
BLOCK = 20_000
BLOCK_BYTES = 32 << 20  # shingles of a block that are compared as sets
PARTNERS = 500  # candidates per task part of one class
PART = 1 << 14


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-size] + 1])
    digest = xxhash.xxh64_intdigest
    pairs = zip(begins.tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[b:e], SEED) for b, e in pairs], np.uint64))


def simhash_rows(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of each row of a matrix of hashes."""
    rows, columns = hashes.shape
    ones = np.zeros((rows, 64), np.int64)
    for at in range(0, columns, PART):
        part = np.ascontiguousarray(hashes[:, at : at + PART])
        bits = np.unpackbits(part.view(np.uint8).reshape(rows, -1, 8), axis=2, bitorder="little")
        ones += bits.sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > columns, axis=1, bitorder="little").view("<u8")[:, 0]


def _seeds(count: int, first: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"sample", first + i) for i in range(count)], np.uint64)


def _lowest(hashes: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """A row per seed: the ``size`` lowest of the hashes, mixed with that seed (all, if fewer)."""
    best = np.zeros((len(seeds), 0), np.uint64)
    for at in range(0, len(hashes), PART):
        mixed = (hashes[at : at + PART] ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        best = np.concatenate([best, mixed], axis=1)
        if best.shape[1] > size:
            best = np.partition(best, size - 1, axis=1)[:, :size]
    return best


_WIDE_SEEDS = _seeds(WIDE[0], 1)
_NARROW_SEEDS = _seeds(NARROW[0], 1 + WIDE[0])


def sample_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The fingerprints of a text's samples, the small ones last; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    found = [simhash_rows(_lowest(hashes, _WIDE_SEEDS, WIDE[1]))]
    if len(hashes) <= SHORT:
        found.append(simhash_rows(_lowest(hashes, _NARROW_SEEDS, NARROW[1])))
    return np.concatenate(found)


def marks(rows: DataFrame, row: str, text_column: str) -> DataFrame:
    """(row, same, n, fp, samples, shingles) of each row; ``same`` names the set of its shingles."""
    texts = rows.select(F.col(row).alias("row"), F.coalesce(text_column, F.lit("")).alias("text"))

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, 1):
            same, size, whole, samples, sets = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text)
                data = hashes.tobytes()
                same.append(hashlib.md5(data).digest())
                size.append(len(hashes))
                whole.append(simhash_rows(hashes[None, :])[0] if len(hashes) else np.uint64(0))
                samples.append(sample_fingerprints(hashes).view(np.int64))
                sets.append(data)
            columns = [
                batch.column(0),
                pa.array(same, pa.binary()),
                pa.array(size, pa.int64()),
                pa.array(np.array(whole, np.uint64).view(np.int64)),
                pa.array(samples, pa.list_(pa.int64())),
                pa.array(sets, pa.binary()),
            ]
            yield pa.record_batch(columns, ["row", "same", "n", "fp", "samples", "shingles"])

    schema = "row long, same binary, n long, fp long, samples array<long>, shingles binary"
    return texts.mapInArrow(mark, schema)


def nearest_before(
    node: np.ndarray, n: np.ndarray, fp: np.ndarray, block: np.ndarray, across: bool, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """(node, the nearest smaller node) by fingerprints within ``FAR``; of other blocks, if ``across``.

    Quick first links; ``similar_apart`` finds what these pass over.
    """
    order = np.argsort(node, kind="stable")
    node, n, fp, block = node[order], n[order], fp[order], block[order]
    m = len(node)
    step = max(1, (1 << 21) // m)
    left, right = [], []
    for at in range(0, m, step):
        rows = np.arange(at, min(at + step, m))
        end = rows[-1] + 1
        far = np.bitwise_count(fp[rows, None] ^ fp[None, :end])
        least = np.minimum(n[rows, None], n[None, :end])
        most = np.maximum(n[rows, None], n[None, :end])
        no = (np.arange(end)[None, :] >= rows[:, None]) | (least < similarity * most)
        if across:
            no |= block[rows, None] == block[None, :end]
        far[no] = 255
        best = far.argmin(axis=1)
        near = far[np.arange(len(rows)), best] <= FAR
        left.append(node[rows[near]])
        right.append(node[best[near]])
    return np.concatenate(left), np.concatenate(right)


def paired_blocks(placed: DataFrame, blocks: Column) -> DataFrame:
    """Rows of buckets (sample, mark) once for each two blocks of the bucket: with their name, block and ``across``.

    The task that pairs a block with itself has ``across`` false; the others hold two blocks.
    """
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.least("block", "with"), F.greatest("block", "with")
    name = F.xxhash64("sample", "mark", *pair)
    return met.withColumns({"name": name, "across": F.col("block") != F.col("with")})


def candidates(classes: DataFrame, similarity: float, block: int) -> DataFrame:
    """(node, other): pairs of classes that share a sample, each with the nearest before it."""
    members = classes.select("node", "n", "fp", F.posexplode("samples").alias("sample", "mark"))
    # Written first: a join whose sides are both plain shuffles is split where a bucket is large.
    buckets = members.groupBy("sample", "mark").agg(F.count("*").alias("size")).where("size > 1")
    shared = members.join(stored(buckets, "buckets"), ["sample", "mark"])
    tasks = paired_blocks(shared, F.ceil(F.col("size") / block))
    tasks = tasks.select("name", "node", "n", "fp", "block", "across")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in grouped_chunks(batches, "name"):
            names = chunk.column("name").to_numpy()
            node, n, place = (chunk.column(c).to_numpy() for c in ("node", "n", "block"))
            fp = chunk.column("fp").to_numpy().view(np.uint64)
            two = chunk.column("across").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
            found = [
                nearest_before(node[b:e], n[b:e], fp[b:e], place[b:e], bool(two[b]), similarity)
                for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
            ]
            both = [np.concatenate(side) for side in zip(*found, strict=True)]
            yield pa.record_batch([pa.array(x) for x in both], ["node", "other"])

    tasks = tasks.repartition("name").sortWithinPartitions("name")
    return tasks.mapInArrow(search, "node long, other long")


def grid_candidates(classes: DataFrame, firsts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, other): classes of one whole fingerprint with its first, and firsts that the grid links."""
    equal = classes.select("node", "fp").join(firsts, "fp").select("node", F.col("first").alias("other"))
    lows = firsts.select(F.col("fp").alias("low"), F.col("first").alias("other"))
    near = links.join(firsts, "fp").join(lows, "low").select(F.col("first").alias("node"), "other")
    return equal.unionAll(near).where("node <> other").distinct()


def similar_apart(
    node: np.ndarray, root: np.ndarray, block: np.ndarray, sets: list[np.ndarray], across: bool, similarity: float
) -> tuple[list[int], list[int]]:
    """Links (node, other) that join all groups with a pair of the similarity; of other blocks, if ``across``.

    Sets are taken by size, each with the smaller ones before it that share a shingle of its prefix: with shingles
    in one order, the rarest first, two sets of the similarity share one of the first n - ceil(similarity n) + 1.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    node, block, sets = node[order], block[order], [sets[i] for i in order]
    label = np.unique(root[order], return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    code, count = rank[code], np.sort(count, kind="stable")
    prefixes = []
    for size, begin, end in zip(sizes.tolist(), begins.tolist(), ends.tolist(), strict=True):
        first = min(size, size - int(np.ceil(similarity * size)) + 1)
        prefix = np.sort(code[begin:end])[:first]
        prefixes.append(prefix[count[prefix] > 1])
    tokens = np.concatenate(prefixes)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in prefixes])
    by_token = np.argsort(tokens, kind="stable")  # owners of a token in the order of size
    owner = owner[by_token]
    starts = np.searchsorted(tokens[by_token], np.arange(len(count)))
    passed = starts.copy()  # end of the owners before the set that is looked at
    mine = np.zeros(len(count), bool)
    left, right = [], []
    for i, prefix in enumerate(prefixes):
        if not len(prefix):
            continue
        lists = [owner[b:e] for b, e in zip(starts[prefix].tolist(), passed[prefix].tolist(), strict=True) if b < e]
        passed[prefix] += 1
        if not lists:
            continue
        other = np.unique(np.concatenate(lists))
        other = other[(label[other] != label[i]) & (sizes[other] >= similarity * sizes[i])]
        if across:
            other = other[block[other] != block[i]]
        if not len(other):
            continue
        mine[code[begins[i] : ends[i]]] = True
        both = np.array([np.count_nonzero(mine[code[begins[j] : ends[j]]]) for j in other.tolist()])
        mine[code[begins[i] : ends[i]]] = False
        for j in other[both >= similarity * (sizes[i] + sizes[other] - both)].tolist():
            if label[j] != label[i]:
                left.append(int(node[i]))
                right.append(int(node[j]))
                label[label == label[j]] = label[i]
    return left, right


def rest_links(
    classes: DataFrame, sets: DataFrame, roots: DataFrame, near: DataFrame, similarity: float, block: int, most: int
) -> DataFrame:
    """(node, other): links of the similarity between classes of different groups in one bucket.

    ``roots`` is (node, low) of the groups so far, ``near`` (fp, low) of whole fingerprints joined by the grid. A bucket
    is what shares a sample, or a whole fingerprint so joined.
    """
    known = classes.join(roots.withColumnRenamed("low", "root"), "node", "left")
    known = known.join(near, "fp", "left").select(
        "node", "n", "samples", F.coalesce("root", "node").alias("root"), F.coalesce("low", "fp").alias("whole")
    )
    known = stored(known, "known")
    place = F.lit(-1).alias("sample"), F.col("whole").alias("mark")
    members = known.select("node", "n", "root", F.posexplode("samples").alias("sample", "mark"))
    members = members.unionAll(known.select("node", "n", "root", *place))
    held = [
        F.count("*").alias("size"),
        (8 * F.sum("n")).alias("bytes"),
        F.bit_xor(F.xxhash64("node")).alias("members"),
        F.bit_xor(F.xxhash64("n", "node")).alias("again"),
    ]
    buckets = members.groupBy("sample", "mark").agg(*held, F.min("root").alias("a"), F.max("root").alias("b"))
    # Texts that share several samples make several buckets of the same members.
    one = F.min(F.struct("sample", "mark")).alias("one")
    buckets = buckets.where("a <> b").groupBy("size", "bytes", "members", "again").agg(one)
    buckets = stored(buckets.select("one.*", "size", "bytes"), "buckets")
    shared = members.join(buckets, ["sample", "mark"])
    tasks = paired_blocks(shared, F.ceil(F.greatest(F.col("size") / block, F.col("bytes") / most)))
    tasks = stored(tasks.select("name", "node", "root", "block", "across"), "tasks")
    needed = stored(tasks.select("node").distinct(), "needed")
    met = tasks.join(sets.join(needed, "node"), "node")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in grouped_chunks(batches, "name", most=TEXT_BYTES):
            names, node, root, place = (chunk.column(c).to_numpy() for c in ("name", "node", "root", "block"))
            two = chunk.column("across").to_numpy()
            shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in chunk.column("shingles")]
            cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
            left, right = [], []
            for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = similar_apart(node[b:e], root[b:e], place[b:e], shingles[b:e], bool(two[b]), similarity)
                left += own[0]
                right += own[1]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (left, right)], ["node", "other"])

    met = met.select("name", "node", "root", "block", "across", "shingles")
    met = met.repartition("name").sortWithinPartitions("name")
    return met.mapInArrow(search, "node long, other long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, other) whose shingle sets have the similarity; ``sets`` is (node, shingles)."""
    loads = pairs.groupBy("other").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    loads = stored(loads, "loads")
    split = pairs.join(loads, "other").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    heads = loads.select(
        F.col("other").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    )
    heads = heads.join(sets, "node").select(
        F.col("node").alias("other"), "part", F.col("shingles").alias("others")
    )
    met = split.join(sets, "node").join(heads, ["other", "part"])

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for mine, theirs in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (mine, theirs))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    met = met.select("node", "other", "shingles", "others")
    return met.mapInArrow(check, "node long, other long")


def one_of_each_copy(
    documents: DataFrame,
    similarity: float = SIMILARITY,
    block: int = BLOCK,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row of each group of near copies, the one with the least id; all columns are kept.

    Nulls among ids come last, and rows of one id in the order of their texts' hashes. Only among
    equal ids and texts does a stored row number decide.
    """
    rows, row = numbered(documents)
    key = F.struct(
        F.col(id_column).isNull().alias("none"),
        F.col(id_column).alias("id"),
        F.xxhash64(text_column).alias("text"),
        F.col(row).alias("row"),
    )
    marked = stored(marks(rows, row, text_column), "marks")
    keys = rows.select(key.alias("key"), F.col(row).alias("row"))
    # A class stands for all rows of one set of shingles; any of its rows has the class's columns.
    classes = (
        marked.select("row", "same", "n", "fp", "samples")
        .groupBy("same")
        .agg(F.min("row").alias("node"), *(F.any_value(c).alias(c) for c in ("n", "fp", "samples")))
    )
    classes = stored(classes, "classes")
    firsts = stored(classes.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    near = stored(grid_links(firsts.select("fp"), MOST_BITS, GROUPS, HOT), "near")
    found = candidates(classes, similarity, block).unionAll(grid_candidates(classes, firsts, near))
    pairs = stored(found.distinct(), "pairs")
    needed = pairs.select("node").unionAll(pairs.select(F.col("other").alias("node"))).distinct()
    whole = marked.select(F.col("row").alias("node"), "shingles")
    sets = stored(whole.join(stored(needed, "needed"), "node"), "sets")
    links = stored(verified(pairs, sets, similarity), "links")
    for table in (pairs, sets):
        discard(table)
    roots = components(links)
    near = components(near).withColumnRenamed("node", "fp")
    rest = rest_links(classes, whole, roots, near, similarity, block, block_bytes)
    rest = stored(rest, "rest")
    if not rest.isEmpty():
        roots = components(roots.unionAll(rest))
    roots = classes.select("same", "node").join(roots, "node", "left")
    roots = stored(roots.select("same", F.coalesce("low", "node").alias("root")), "roots")
    # Partial aggregation by root, so a group with a third of all rows sends a row per task.
    rooted = marked.select("row", "same").join(roots, "same").join(keys, "row")
    kept = rooted.groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.row").alias("row"))
    gone = marked.select("row").join(kept, "row", "left_anti").withColumnRenamed("row", row)
    gone = stored(gone, "gone")
    for table in (marked, classes, links, roots):
        discard(table)
    return rows.join(gone, row, "left_anti").select(*documents.columns)

"""Finding every fixed-length window that occurs twice, without comparing all windows.

A window of W units (words or bytes) is told by its *anchor*: the place of the smallest gram hash
among the grams of G units that lie in the window, the leftmost of equals. The anchor depends on the
window's content alone, so equal windows have anchors at equal offsets, and a window can only repeat
if the gram at its anchor does. That gives a chain of joins:

1. Tasks scan whole texts and write one row per anchor (gram hash, document, place, and the range of
   offsets of the windows it stands for).
2. Anchors whose gram hash occurs once are dropped. Counting is pre-aggregated, and the join that
   drops them may be split where one gram is very frequent.
3. The rest fetch their surroundings from the documents and meet by gram hash: the suffixes that
   start with one gram lie together. How a group's suffixes are ordered is the caller's method; from
   the order and its common prefix lengths the repeated windows of all members follow.
4. A gram with more than ``heavy`` anchors would be too large a group. Its prefix is lengthened to
   the whole window: each window of it is a row of its own, and equal windows are counted with
   pre-aggregation and matched by a join that can be split. No row is dropped either way.

The first W units of a group's suffixes are compared as they are; what precedes an anchor is compared
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from cellkpi.llm.common import discard, grouped_chunks, sized_slices, stored

CHUNK = 1 << 19
PLACE_BITS = np.uint64(24)
PLACE_MASK = np.uint64((1 << 24) - 1)
BASE = 0x9E3779B97F4A7C15
HEAVY = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2^64, by doubling."""
    out = np.ones(max(1, n), np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


Loci = Callable[[np.ndarray, np.ndarray], Callable[[int], np.ndarray]]


def runs(order: np.ndarray, lcp: np.ndarray) -> Callable[[int], np.ndarray]:
    """A function that numbers, by depth, the runs of the order that share a prefix of that depth."""

    def at(depth: int) -> np.ndarray:
        run = np.empty(len(order), np.int64)
        run[order] = np.cumsum(lcp < depth)
        return run

    return at


@dataclass(frozen=True)
class Scheme:
    """How texts become units. ``codes``: a 64-bit code per unit; ``raw``: what a slice of is shipped.

    ``loci`` turns sorted suffixes and their common prefixes into a look-up of prefixes by falling depth.

    ``window`` and ``gram`` are counted in units; a window holds ``window - gram + 1`` grams.
    """

    window: int
    gram: int
    codes: Callable[[bytes], np.ndarray]
    raw: Callable[[bytes], np.ndarray]
    to_codes: Callable[[np.ndarray], np.ndarray]
    raw_type: type
    heavy: int = HEAVY
    loci: Loci = runs

    @property
    def grams(self) -> int:
        return self.window - self.gram + 1


class Sampler:
    """Anchors of texts, found in chunks of bounded size."""

    def __init__(self, scheme: Scheme):
        self.scheme = scheme
        size = CHUNK + 2 * scheme.window
        inverse = pow(BASE, -1, 1 << 64)
        self.up, self.down = powers(BASE, size + 1), powers(inverse, size + 1)

    def gram_hashes(self, codes: np.ndarray) -> np.ndarray:
        k = self.scheme.gram
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=total[1:])
        return mixed((total[k:] - total[:-k]) * self.down[: len(codes) - k + 1])

    def anchors(self, segments: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """(gram hash, row, place) of the anchors of segments (row, offset in the text, codes)."""
        window, grams = self.scheme.window, self.scheme.grams
        codes = np.concatenate([c for _, _, c in segments])
        sizes = np.array([len(c) for _, _, c in segments])
        begins = np.cumsum(sizes) - sizes
        hashes = self.gram_hashes(codes)
        low = (hashes >> PLACE_BITS << PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while span * 2 <= grams:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < grams:
            low = np.minimum(low[: span - grams], low[grams - span :])
        valid = np.ones(len(codes), bool)
        ends = begins + sizes
        for back in range(1, window):
            valid[ends - back] = False
        start = np.flatnonzero(valid[: len(low)])
        place = (low[start] & PLACE_MASK).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        anchor = place[first]
        most, least = anchor - start[first], anchor - start[last]
        segment = np.searchsorted(begins, anchor, "right") - 1
        rows = np.array([r for r, _, _ in segments], np.int64)[segment]
        offsets = np.array([o for _, o, _ in segments], np.int64)[segment]
        where = anchor - begins[segment] + offsets
        return hashes[anchor].view(np.int64), rows, where << 16 | least << 8 | most

    def chunks(self, texts: Iterable[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        window = self.scheme.window
        held: list[tuple[int, int, np.ndarray]] = []
        count = 0
        for row, text in texts:
            codes = self.scheme.codes(text)
            for offset in range(0, len(codes) - window + 1, CHUNK):
                part = codes[offset : offset + CHUNK + window - 1]
                if held and count + len(part) > CHUNK + window:
                    yield self.anchors(held)
                    held, count = [], 0
                held.append((row, offset, part))
                count += len(part)
        if held:
            yield self.anchors(held)


def numbered(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, row, text) with a distinct long ``row`` per document that orders like the id.

    An integer id without nulls and repeats is its own row number. Otherwise rows are numbered by
    id and text, nulls first, so that rows with the same id are documents of their own.
    """
    texts = documents.select(
        F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text")
    )
    if isinstance(texts.schema["doc_id"].dataType, (LongType, IntegerType, ShortType, ByteType)):
        ids = texts.groupBy("doc_id").count()
        if ids.where("doc_id is null or count > 1").isEmpty():
            return texts.select("doc_id", F.col("doc_id").cast("long").alias("row"), "text")
    ordered = texts.orderBy(F.asc_nulls_first("doc_id"), "text")
    return stored(ordered.withColumn("row", F.monotonically_increasing_id()), "numbered")


def sample(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The anchors of all documents: (h, row, place)."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(scheme)
        for batch in sized_slices(batches, 1):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = batch.column(0).to_pylist()
            for arrays in sampler.chunks(zip(rows, texts, strict=True)):
                yield pa.record_batch(list(map(pa.array, arrays)), ["h", "row", "place"])

    texts = docs.select("row", "text")
    return texts.mapInArrow(find, "h long, row long, place long")


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, least and most offset of a packed place."""
    return place >> 16, place >> 8 & 255, place & 255


def _joined(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(row, text, hashes, places) of a batch of (row, text, found)."""
    rows, found = batch.column(0).to_pylist(), batch.column(2)
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    bounds = found.offsets.to_numpy()
    inner = found.values
    hashes, places = inner.field(0).to_numpy(), inner.field(1).to_numpy()
    for i, (row, text) in enumerate(zip(rows, texts, strict=True)):
        part = slice(bounds[i], bounds[i + 1])
        yield row, text, hashes[part], places[part]


def surroundings(found: DataFrame, scheme: Scheme) -> DataFrame:
    """(h, row, place, context): each anchor with all units of the windows it stands for."""
    window = scheme.window

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, 1, 1 << 20):
            hs, rows, ps, contexts = [], [], [], []
            for row, text, hashes, places in _joined(batch):
                raw = scheme.raw(text)
                at, least, most = unpacked(places)
                begin, end = (at - most).tolist(), (at - least + window).tolist()
                contexts += [raw[b:e].tobytes() for b, e in zip(begin, end, strict=True)]
                hs.append(hashes)
                ps.append(places)
                rows.append(np.full(len(hashes), row))
            if contexts:
                arrays = [np.concatenate(x) for x in (hs, rows, ps)]
                yield pa.record_batch(
                    [*map(pa.array, arrays), pa.array(contexts, pa.binary())],
                    ["h", "row", "place", "context"],
                )

    return found.mapInArrow(cut, "h long, row long, place long, context binary")


def windows(found: DataFrame, scheme: Scheme) -> DataFrame:
    """(w1, w2, row, start): every window of the anchors, told by a 128-bit hash of its units."""
    size = scheme.window

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [powers(b, size)[::-1] for b in (BASE, 0xD1342543DE82EF95)]
        for batch in sized_slices(batches, 1, 1 << 18):
            for row, text, _, places in _joined(batch):
                codes = scheme.codes(text)
                at, least, most = unpacked(places)
                starts = [np.arange(a - m, a - n + 1) for a, n, m in zip(at, least, most, strict=True)]
                start = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
                for part in np.array_split(start, len(start) // 20_000 + 1):
                    view = np.lib.stride_tricks.sliding_window_view(codes, size)[part]
                    w1, w2 = (mixed((view * top).sum(axis=1)).view(np.int64) for top in tops)
                    ids = np.full(len(part), row)
                    yield pa.record_batch(
                        list(map(pa.array, (w1, w2, ids, part))), ["w1", "w2", "row", "start"]
                    )

    return found.mapInArrow(spell, "w1 long, w2 long, row long, start long")


def repeated_offsets(
    locus: Callable[[int], np.ndarray],
    left: Callable[[int], np.ndarray],
    least: np.ndarray,
    most: np.ndarray,
    age: np.ndarray,
    window: int,
    keep_first: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest offset at which each suffix's window repeats (1 and 0 if none does).

    For an offset o a window is ``left(o)`` (a hash of the o units before the anchor) and the first
    ``window - o`` units from it; suffixes that share the latter have one ``locus``. With ``keep_first`` the suffix of least ``age`` among equal windows does
    not count as a repeat.
    """
    n = len(least)
    low, high = np.ones(n, np.int64), np.zeros(n, np.int64)
    some = np.zeros(n, bool)
    if not n:
        return low, high
    for o in range(int(least.min()), int(most.max()) + 1):
        node = locus(window - o)
        live = np.flatnonzero((least <= o) & (most >= o))
        if len(live) < 2:
            left(o)
            continue
        key = mixed(left(o)[live] ^ mixed(node[live].view(np.uint64)))
        by_key = np.lexsort((age[live], key)) if keep_first else np.argsort(key)
        key = key[by_key]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        if not keep_first:
            same[:-1] |= same[1:]
        hit = live[by_key[same]]
        low[hit] = np.where(some[hit], low[hit], o)
        high[hit] = o
        some[hit] = True
    return low, high


def left_hashes(codes: np.ndarray, anchor: np.ndarray, most: np.ndarray) -> Callable[[int], np.ndarray]:
    """A function that gives, for offsets that rise by one, hashes of as many units before an anchor.

    ``codes`` holds the units of all contexts, ``anchor`` the anchors' places in it.
    """
    state = np.zeros(len(anchor), np.uint64)
    done = 0

    def at(offset: int) -> np.ndarray:
        nonlocal done
        while done < offset:
            done += 1
            fit = np.flatnonzero(most >= done)
            state[fit] = state[fit] * np.uint64(BASE) + codes[anchor[fit] - done]
        return state

    return at


Ordering = Callable[[np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray]]


def group_spans(
    chunk: pa.Table, scheme: Scheme, order_suffixes: Ordering, keep_first: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the repeated windows of whole groups of anchors with one gram hash.

    Anchors with equal context and offsets are one class, since they repeat alike.
    ``order_suffixes`` sorts the classes by gram hash and suffix and gives the common prefixes.
    """
    window, width = scheme.window, np.dtype(scheme.raw_type).itemsize
    h = chunk.column("h").to_numpy()
    row, place = chunk.column("row").to_numpy(), chunk.column("place").to_numpy()
    at, least, most = unpacked(place)
    contexts = chunk.column("context").to_pylist()
    seen: dict[tuple, int] = {}
    names = zip(h.tolist(), (place & 0xFFFF).tolist(), contexts, strict=True)
    cls = np.fromiter((seen.setdefault(x, len(seen)) for x in names), np.int64, len(h))
    n = len(seen)
    count = np.bincount(cls, minlength=n)
    by_age = np.lexsort((at, row))
    member = np.empty(n, np.int64)
    member[cls[by_age[::-1]]] = by_age[::-1]  # the earliest member is written last
    age = np.empty(len(h), np.int64)
    age[by_age] = np.arange(len(h))

    classes = list(seen)
    c_h = h[member]
    alone = np.ones(n, bool)
    if n > 1:  # classes come in the order of h
        same = c_h[1:] == c_h[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
    pick = np.flatnonzero(~alone)
    low, high = np.ones(n, np.int64), np.zeros(n, np.int64)
    if len(pick):
        c_least, c_most = least[member[pick]], most[member[pick]]
        suffixes = [classes[i][2][m * width :] for i, m in zip(pick, c_most, strict=True)]
        order, lcp = order_suffixes(c_h[pick], suffixes)
        flat = np.frombuffer(b"".join(classes[i][2] for i in pick), scheme.raw_type)
        sizes = window + c_most - c_least
        anchor = np.cumsum(sizes) - sizes + c_most
        left = left_hashes(scheme.to_codes(flat), anchor, c_most)
        low[pick], high[pick] = repeated_offsets(
            scheme.loci(order, lcp), left, c_least, c_most, age[member[pick]], window, keep_first
        )
    if keep_first:
        whole = np.arange(len(h)) != member[cls]
    else:
        whole = (count > 1)[cls]
    first = np.where(whole, most, high[cls])
    last = np.where(whole, least, low[cls])
    found = first >= last
    return row[found], (at - first)[found], (at - last + window)[found]


def repeated_spans(
    docs: DataFrame, scheme: Scheme, order_suffixes: Ordering, keep_first: bool
) -> DataFrame:
    """(row, begin, end) in units of spans that repeated windows cover; spans may overlap."""
    anchors = stored(sample(docs, scheme), "anchors")
    # Written first: a join whose sides are both plain shuffles is split where a gram is frequent.
    counts = stored(anchors.groupBy("h").count().where("count > 1"), "counts")
    place = F.struct("h", "place", (F.col("count") > scheme.heavy).alias("heavy"))
    again = anchors.join(counts, "h").groupBy("row").agg(F.collect_list(place).alias("found"))
    again = stored(again, "again")
    discard(anchors)
    discard(counts)

    def with_text(wanted: Callable[[Column], Column]) -> DataFrame:
        found = again.withColumn("found", F.filter("found", wanted)).where(F.size("found") > 0)
        return docs.select("row", "text").join(found, "row").select("row", "text", "found")

    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in grouped_chunks(batches, "h"):
            arrays = group_spans(chunk, scheme, order_suffixes, keep_first)
            yield pa.record_batch(list(map(pa.array, arrays)), ["row", "begin", "end"])

    schema = "row long, begin long, end long"
    light = surroundings(with_text(lambda x: ~x["heavy"]), scheme)
    light = light.repartition("h").sortWithinPartitions("h").mapInArrow(spans, schema)

    light = stored(light, "spans")
    heavy = lambda x: x["heavy"]
    if again.where(F.exists("found", heavy)).isEmpty():
        discard(again)
        return light

    each = stored(windows(with_text(heavy), scheme), "windows")
    discard(again)
    first = F.min(F.struct("row", "start")).alias("first")
    twice = each.groupBy("w1", "w2").agg(F.count("*").alias("n"), first).where("n > 1")
    matched = each.join(stored(twice, "twice"), ["w1", "w2"])
    if keep_first:
        matched = matched.where(F.struct("row", "start") != F.col("first"))
    end = (F.col("start") + scheme.window).alias("end")
    return light.unionAll(matched.select("row", F.col("start").alias("begin"), end))


def covered(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that spans cover; spans that touch are one run."""
    if not len(begins):
        return begins, ends
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], begins[1:] > reach[:-1]])
    at = np.flatnonzero(fresh)
    return begins[at], reach[np.append(at[1:], len(reach)) - 1]


def with_runs(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans of each as an array ``spans`` (null if it has none)."""
    per_row = spans.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return docs.join(per_row, "row", "left").select("doc_id", "text", "spans")


def text_runs(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(text, begins, ends) of a batch of (doc_id, text, spans)."""
    spans = batch.column(2)
    bounds, valid = spans.offsets.to_numpy(), spans.is_valid().to_pylist()
    begins, ends = (spans.values.field(i).to_numpy() for i in (0, 1))
    for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
        part = slice(bounds[i], bounds[i + 1]) if valid[i] else slice(0, 0)
        yield text, *covered(begins[part], ends[part])

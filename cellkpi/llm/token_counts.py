"""Token counts by merging whole batches of pre-tokens at once.

The symbols of all pre-tokens of a batch lie in one flat array with the bounds of each pre-token
beside it. A round finds the lowest-ranked adjacent pair of every pre-token and merges all its
occurrences, in all pre-tokens together. A pre-token leaves the arrays when no known pair is left;
the symbols it then holds are its tokens. Spark spreads documents over tasks; a task keeps the
counts of pre-tokens it has met in a table of bounded size.

Null and empty texts have no tokens. Repeated rows give repeated rows. Columns besides the id and
the text are ignored, whatever they are called.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellkpi.llm import tokenizing
from cellkpi.llm.common import sized_slices

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
NO_RANK = np.iinfo(np.int32).max


class MergeTable:
    """Ranks and results of the pairs of one byte-level BPE file, in a hash table of arrays."""

    SLOT_BITS = 20
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        ids = content["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]]
        self.size = max(ids.values()) + 1
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.first = np.array([ids[c] for c in tokenizing.byte_symbols()], np.int32)
        self.specials = [t["content"] for t in content.get("added_tokens", []) if t["special"]]
        slots = self._slots(keys)
        self.slot_key = np.full(1 << self.SLOT_BITS, -1, np.int64)
        self.slot_rank = np.full(1 << self.SLOT_BITS, NO_RANK, np.int32)
        self.slot_key[slots] = keys
        self.slot_rank[slots] = np.arange(len(keys))
        # Keys that lost their slot to another are looked up by bisection.
        lost = np.flatnonzero(self.slot_key[slots] != keys)
        lost = lost[np.argsort(keys[lost])]
        self.lost_key, self.lost_rank = np.append(keys[lost], -1)[:-1], lost.astype(np.int32)
        self.crowded = np.zeros(1 << self.SLOT_BITS, bool)
        self.crowded[slots[lost]] = True

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self.MIX >> np.uint64(64 - self.SLOT_BITS)).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NO_RANK."""
        wanted = left.astype(np.int64) * self.size + right
        slots = self._slots(wanted)
        hit = self.slot_key[slots] == wanted
        out = np.where(hit, self.slot_rank[slots], np.int32(NO_RANK))
        rest = np.flatnonzero(~hit & self.crowded[slots])
        if len(rest):
            at = np.searchsorted(self.lost_key, wanted[rest])
            at = np.minimum(at, len(self.lost_key) - 1)
            same = self.lost_key[at] == wanted[rest]
            out[rest[same]] = self.lost_rank[at[same]]
        return out


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def count_symbols(merges: MergeTable, pretokens: list[bytes]) -> np.ndarray:
    """The number of tokens of each pre-token."""
    sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
    counts = sizes.copy()
    live = np.flatnonzero(sizes > 1)
    if not len(live):
        return counts
    flat = b"".join([pretokens[i] for i in live.tolist()])
    symbols = merges.first[np.frombuffer(flat, np.uint8)]
    lengths = sizes[live]
    starts = np.cumsum(lengths) - lengths
    rank = np.full(len(symbols), NO_RANK, np.int32)
    rank[:-1] = merges.ranks(symbols[:-1], symbols[1:])
    rank[starts[1:] - 1] = NO_RANK  # the last symbol of a pre-token begins no pair
    while True:
        lowest = np.minimum.reduceat(rank, starts)
        going = lowest != NO_RANK
        counts[live[~going]] = lengths[~going]
        if not going.any():
            return counts
        if not going.all():
            kept = np.repeat(going, lengths)
            live, lengths, lowest = live[going], lengths[going], lowest[going]
            symbols, rank = symbols[kept], rank[kept]
            starts = np.cumsum(lengths) - lengths
        at = np.flatnonzero(rank == np.repeat(lowest, lengths))
        # Of overlapping occurrences (aa in aaa) every second one counts, from the left.
        if len(at) > len(live):
            fresh = np.concatenate([[True], np.diff(at) > 1])
            run = np.maximum.accumulate(np.where(fresh, at, 0))
            at = at[(at - run) % 2 == 0]
        ends = np.zeros(len(symbols) + 1, bool)  # where a pre-token ends
        ends[starts + lengths - 1] = True
        ends[at] |= ends[at + 1]
        symbols[at] = merges.merged[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, rank, ends = symbols[keep], rank[keep], ends[:-1][keep]
        at -= np.arange(len(at))  # a merge moves what follows by one
        lengths = np.diff(np.flatnonzero(ends), prepend=-1)
        starts = np.cumsum(lengths) - lengths
        for left in (at, at[at > 0] - 1):
            rank[left] = NO_RANK
            left = left[~ends[left]]
            rank[left] = merges.ranks(symbols[left], symbols[left + 1])


class Counter:
    """Counts texts, remembering pre-tokens up to a bound."""

    def __init__(self, path: str):
        self.merges = merge_table(path)
        self.known: dict[str, int] = {}

    def text(self, text: str) -> int:
        total = 0
        parts = [text]
        for special in self.merges.specials:
            split = [part.split(special) for part in parts]
            total += sum(len(x) - 1 for x in split)
            parts = [x for xs in split for x in xs]
        for part in parts:
            for piece in tokenizing.pieces(part):
                total += self._piece(piece)
        return total

    def _piece(self, piece: str) -> int:
        found = tokenizing.split(piece)
        self.learn([found])
        return sum(map(self.known.__getitem__, found))

    def learn(self, lists: list[list[str]]) -> None:
        new = set().union(*lists).difference(self.known)
        if len(self.known) + len(new) > tokenizing.CACHE_ENTRIES:
            self.known = {}
            new = set().union(*lists)
        if new:
            names = list(new)
            counts = count_symbols(self.merges, [x.encode() for x in names])
            self.known.update(zip(names, counts.tolist(), strict=True))

    def texts(self, texts: list[str]) -> list[int]:
        """Counts of many texts; all their unknown pre-tokens are merged in one go."""
        plain = [
            i
            for i, t in enumerate(texts)
            if len(t) <= tokenizing.PIECE_CHARS and not any(s in t for s in self.merges.specials)
        ]
        found = {i: tokenizing.split(texts[i]) for i in plain}
        self.learn(list(found.values()))
        know = self.known.__getitem__
        done = {i: sum(map(know, xs)) for i, xs in found.items()}
        return [done[i] if i in done else self.text(t) for i, t in enumerate(texts)]


def count_tokens(
    documents: DataFrame,
    vocabulary: str | None = None,
    limit: int = TOKEN_LIMIT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per document: its id, UTF-8 bytes, tokens and whether the tokens exceed ``limit``.

    ``vocabulary`` is the path of a byte-level BPE file in the ``tokenizers`` layout, readable on
    every machine.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    texts = documents.select(
        F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text")
    )
    kind = texts.schema["doc_id"].dataType

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in sized_slices(batches, 1):
            texts = batch.column(1).to_pylist()
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counter.texts(texts), pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = texts.mapInArrow(
        count, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

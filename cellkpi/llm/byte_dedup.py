"""Removing repeated byte strings by deep-shallow sorting of suffixes.

Suffixes that start with the same gram form a group (``repeats`` has the partitioning and the
sampling of suffixes). A group is sorted in two ways by depth: multikey quicksort on eight bytes at
a time down to a shallow depth, then, for suffixes that still agree, a blind trie each, which
compares a suffix with one other only and keeps no more than the bytes where suffixes part. The
order gives the common prefix of neighbours, and these give the repeated strings.

A null text is empty. A document shorter than a window loses nothing. Rows with a null id, or an id
that occurs twice, are documents of their own. Columns besides the id and the text are ignored,
whatever they are called. Removing bytes may leave parts of UTF-8 characters, so results are bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellkpi.llm import repeats
from cellkpi.llm.common import sized_slices

WINDOW, GRAM = 200, 64
SHALLOW = 80

BYTE_CODES = repeats.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(repeats.BASE))


def byte_codes(text: bytes) -> np.ndarray:
    return BYTE_CODES[np.frombuffer(text, np.uint8)]


def raw_bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def multikey_quicksort(
    groups: np.ndarray, words: np.ndarray, depth: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of ``words`` within each group by their first ``depth`` words.

    Returns the order, and for each place of it the start of its part: rows of one part agree in
    all these words. A round takes a pivot for every part that is not done and splits it into less,
    equal and greater; the equal part goes on with the next word. All parts are split together.
    """
    n = len(groups)
    order = np.argsort(groups, kind="stable")
    part = np.concatenate([[True], np.diff(groups[order]) != 0])
    start = np.maximum.accumulate(np.where(part, np.arange(n), 0))
    level = np.zeros(n, np.int64)
    while True:
        size = np.bincount(start, minlength=n)[start]
        live = np.flatnonzero((size > 1) & (level < depth))
        if not len(live):
            return order, start
        value = words[order[live], level[live]]
        pivot = words[order[start[live] + size[live] // 2], level[live]]
        side = 1 + (value > pivot).astype(np.int64) - (value < pivot)
        by = np.argsort(start[live] * 3 + side, kind="stable")
        order[live] = order[live][by]
        side = side[by]
        level[live] += side == 1  # live places keep their part, so starts are still right
        name = start[live] * 3 + side
        fresh = np.concatenate([[True], name[1:] != name[:-1]])
        start[live] = np.maximum.accumulate(np.where(fresh, live, 0))


def common_prefix(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    unlike = int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")
    return size - (unlike.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """The sorted order of the strings, through a trie of the places where they part.

    A node is [depth, {byte: child}]; a leaf is the list of equal strings. A string goes down by its
    bytes at the nodes' depths alone, is compared with the leaf it meets, and enters where the two
    part. The byte -1 stands for the end of a string.
    """
    root: list = [0]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while isinstance(node, tuple):
            depth, children = node
            byte = s[depth] if depth < len(s) else -1
            node = children[byte] if byte in children else next(iter(children.values()))
        other = strings[node[0]]
        shared = common_prefix(s, other)
        if shared == len(s) == len(other):
            node.append(i)
            continue
        above, node = None, root
        while isinstance(node, tuple) and node[0] < shared:
            above = node
            node = node[1][s[node[0]]]
        mine = s[shared] if shared < len(s) else -1
        if isinstance(node, tuple) and node[0] == shared:
            node[1][mine] = [i]
            continue
        split = (shared, {other[shared] if shared < len(other) else -1: node, mine: [i]})
        if above is None:
            root = split
        else:
            above[1][s[above[0]]] = split
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            out += node
        else:
            stack += [node[1][byte] for byte in sorted(node[1], reverse=True)]
    return out


def deep_shallow_order(h: np.ndarray, suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted within each gram hash, and the bytes that each shares with the one before."""
    n = len(suffixes)
    sizes = np.array([len(s) for s in suffixes])
    width = -(-int(sizes.max()) // 8) * 8
    grid = np.zeros((n, width), np.uint8)
    grid[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(suffixes), np.uint8)
    words = grid.view(">u8").astype(np.uint64)
    order, start = multikey_quicksort(h, words, min(SHALLOW // 8, words.shape[1]))
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(start) != 0, [True]]))
    deep = np.flatnonzero(np.diff(bounds) > 1)
    for b, e in zip(bounds[deep].tolist(), bounds[deep + 1].tolist(), strict=True):
        mine = order[b:e]
        order[b:e] = mine[blind_trie_order([suffixes[i] for i in mine.tolist()])]
    unlike = grid[order[1:]] != grid[order[:-1]]
    shared = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    shared = np.minimum(shared, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(h[order[1:]] == h[order[:-1]], shared, 0)
    return order, lcp


def scheme(window: int = WINDOW, gram: int = GRAM, heavy: int = repeats.HEAVY) -> repeats.Scheme:
    to_codes = BYTE_CODES.__getitem__
    return repeats.Scheme(window, gram, byte_codes, raw_bytes, to_codes, np.uint8, heavy)


def remove_repeated_bytes(
    documents: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    heavy: int = repeats.HEAVY,
    with_bytes: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per document: bytes, removed bytes, maximal removed runs, SHA-256 of what is left.

    A byte goes if it lies in a string of ``window`` bytes that also starts anywhere else.
    ``with_bytes`` adds ``kept``, the remaining bytes. ``heavy`` is the size from which a group's
    prefix is lengthened.
    """
    docs = repeats.numbered(documents, id_column, text_column)
    spans = repeats.repeated_spans(docs, scheme(window, gram, heavy), deep_shallow_order, False)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, 1):
            counts, removed, runs, hashes, left = [], [], [], [], []
            for text, begins, ends in repeats.text_runs(batch):
                gone = int((ends - begins).sum())
                parts = zip([0, *ends.tolist()], [*begins.tolist(), len(text)], strict=True)
                kept = b"".join(text[b:e] for b, e in parts)
                counts.append(len(text))
                removed.append(gone)
                runs.append(len(begins))
                hashes.append(hashlib.sha256(kept).hexdigest())
                if with_bytes:
                    left.append(kept)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (counts, removed, runs))]
            columns.append(pa.array(hashes, pa.string()))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                columns.append(pa.array(left, pa.binary()))
                names.append("kept")
            yield pa.record_batch(columns, names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeats.with_runs(docs, spans).mapInArrow(cut, schema + ", kept binary" * with_bytes)

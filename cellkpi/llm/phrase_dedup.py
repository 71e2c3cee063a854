"""Removing repeated word windows by prefix-partitioned suffix trees.

Suffixes are split by variable-length prefixes: a prefix of some words for most, the whole window
where a prefix is too frequent for one group (``repeats`` has the partitioning and the sampling of
suffixes; a group of whole windows has one node, the window, and is counted). Each group sorts its suffixes
and grows its subtrees from the common prefixes of neighbours (``suffix_tree``). What a deep internal node
spells is a repeat; a window is looked up at the node where its words from the anchor on end, and
repeats if another window ends at that node with the same words before its anchor.

Words are runs without ASCII white space, unchanged, told by 64-bit hashes. A null text has no
words. A document with fewer words than a window loses none. Rows with a null id, or an id that
occurs twice, are documents of their own, in the order of id (nulls first) and text. Columns besides
the id and the text are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from cellkpi.llm import repeats, suffix_tree
from cellkpi.llm.common import sized_slices

WINDOW, GRAM = 20, 6
WORD_CACHE = 400_000


class _WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_known = _WordCodes()


def word_codes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def suffix_tree_order(h: np.ndarray, suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (64-bit words) in tree order, and the depth of the node where each leaves its predecessor.

    That depth is the words they share; suffixes of different groups share none.
    """
    sizes = np.array([len(s) // 8 for s in suffixes])
    widest = int(sizes.max())
    filled = np.arange(widest) < sizes[:, None]
    words = np.zeros((len(suffixes), widest), np.uint64)
    words[filled] = np.frombuffer(b"".join(suffixes), np.uint64)
    order = np.lexsort((*words.T[::-1], h))
    words, sizes, h = words[order], sizes[order], h[order]
    unlike = words[1:] != words[:-1]
    shared = np.where(unlike.any(axis=1), unlike.argmax(axis=1), widest)
    shared = np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))
    depth = np.zeros(len(order), np.int64)
    depth[1:] = np.where(h[1:] == h[:-1], shared, 0)
    return order, depth


def scheme(window: int = WINDOW, gram: int = GRAM, heavy: int = repeats.HEAVY) -> repeats.Scheme:
    return repeats.Scheme(
        window, gram, word_codes, word_codes, lambda x: x, np.uint64, heavy, suffix_tree.loci
    )


def remove_repeated_phrases(
    documents: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    heavy: int = repeats.HEAVY,
    with_text: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per document: words, removed words, SHA-256 of the kept ones joined by spaces.

    A word goes if it lies in a window of ``window`` words that also starts earlier: in a document of
    smaller id, or before in its own. ``with_text`` adds ``kept_text``. ``heavy`` is the size from
    which a group's prefix is lengthened.
    """
    docs = repeats.numbered(documents, id_column, text_column)
    spans = repeats.repeated_spans(docs, scheme(window, gram, heavy), suffix_tree_order, True)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, 1):
            counts, removed, hashes, texts = [], [], [], []
            for text, begins, ends in repeats.text_runs(batch):
                words = text.split()
                for b, e in zip(begins[::-1].tolist(), ends[::-1].tolist(), strict=True):
                    del words[b:e]
                gone = int((ends - begins).sum())
                kept = b" ".join(words)
                counts.append(len(words) + gone)
                removed.append(gone)
                hashes.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            columns.append(pa.array(hashes, pa.string()))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.record_batch(columns, names)

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    return repeats.with_runs(docs, spans).mapInArrow(cut, schema + ", kept_text string" * with_text)

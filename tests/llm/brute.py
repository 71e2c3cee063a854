"""Slow, plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def phrases(docs: list[tuple], window: int) -> dict:
    """doc_id -> (n_words, n_removed, sha); docs are (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc] = (len(words), len(gone), sha(kept))
    return out


def byte_strings(docs: list[tuple], window: int) -> dict:
    """doc_id -> (n_bytes, n_removed, n_spans, sha)."""
    places = defaultdict(int)
    data = {doc: (text or "").encode() for doc, text in docs}
    for text in data.values():
        for i in range(len(text) - window + 1):
            places[text[i : i + window]] += 1
    out = {}
    for doc, text in data.items():
        gone = bytearray(len(text))
        for i in range(len(text) - window + 1):
            if places[text[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(text), sum(gone), spans, sha(kept))
    return out

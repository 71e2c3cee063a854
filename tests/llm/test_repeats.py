import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cellkpi.llm import byte_dedup, phrase_dedup
from tests.llm import brute


def corpus(seed, count=60, alphabet=40):
    """Texts with shared passages, copies, near copies, runs and short ones."""
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(alphabet)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [draw(rng.randrange(5, 40)) for _ in range(5)]
    texts = ["", None, " \t\n", "one", " ".join(["same"] * 90)]
    while len(texts) < count:
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice(shared) if rng.random() < 0.4 else draw(rng.randrange(0, 40))
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
        if rng.random() < 0.3:
            copy = list(parts)
            if rng.random() < 0.6 and copy:
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def texts(spark):
    docs = corpus(1)
    return docs, spark.createDataFrame(docs, "doc_id long, text string").repartition(3).cache()


@pytest.mark.parametrize(("window", "gram", "heavy"), [(8, 3, 1000), (8, 3, 2), (5, 5, 3), (9, 1, 50)])
def test_phrases_like_brute_force(texts, window, gram, heavy):
    docs, df = texts
    rows = phrase_dedup.remove_repeated_phrases(df, window, gram, heavy).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
    assert got == brute.phrases(docs, window)


@pytest.mark.parametrize(("window", "gram", "heavy"), [(40, 13, 1000), (40, 13, 2), (25, 8, 5)])
def test_bytes_like_brute_force(texts, window, gram, heavy):
    docs, df = texts
    rows = byte_dedup.remove_repeated_bytes(df, window, gram, heavy).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == brute.byte_strings(docs, window)


def test_long_texts_are_cut_into_chunks(spark, monkeypatch):
    from cellkpi.llm import repeats

    docs = [(d, t) for d, t in corpus(2, 12, 9) if t]
    scheme = phrase_dedup.scheme(8, 3)
    whole = {}
    for chunk in (1 << 19, 16):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        found = repeats.Sampler(scheme).chunks([(d, t.encode()) for d, t in docs])
        windows = set()
        for hashes, rows, places in found:
            at, least, most = repeats.unpacked(places)
            for h, r, a, lo, hi in zip(hashes, rows, at, least, most, strict=True):
                windows |= {(h, r, a, a - o) for o in range(lo, hi + 1)}
        whole[chunk] = windows
    assert whole[16] == whole[1 << 19]


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame(
        [(None, text, "x"), (3, text, "x"), (3, text, "y"), (4, None, None)],
        "doc_id long, text string, row string",
    )
    rows = phrase_dedup.remove_repeated_phrases(df).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [
        ("3", 30),
        ("3", 30),
        ("4", 0),
        ("None", 0),
    ]
    again = byte_dedup.remove_repeated_bytes(df, 20, 8).collect()
    assert sorted((str(r.doc_id), r.n_bytes - r.n_removed) for r in again) == [
        ("3", 0),
        ("3", 0),
        ("4", 0),
        ("None", 0),
    ]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, begin int, h string")
    assert phrase_dedup.remove_repeated_phrases(df).collect() == []
    assert byte_dedup.remove_repeated_bytes(df).collect() == []


@given(st.lists(st.binary(max_size=12), min_size=1, max_size=30), st.booleans())
def test_deep_shallow_order_sorts(strings, narrow):
    if narrow:
        strings = [bytes(c % 2 for c in s) for s in strings]
    strings = [b"\x01" * 78 + s for s in strings]
    h = np.array([len(s) % 2 for s in strings])
    order, lcp = byte_dedup.deep_shallow_order(h, strings)
    keys = [(h[i], strings[i]) for i in order]
    assert keys == sorted(keys)
    for i in range(1, len(keys)):
        same = keys[i][0] == keys[i - 1][0]
        assert lcp[i] == (byte_dedup.common_prefix(keys[i][1], keys[i - 1][1]) if same else 0)


@given(st.lists(st.binary(max_size=6), min_size=1, max_size=40))
def test_blind_trie_sorts(strings):
    order = byte_dedup.blind_trie_order(strings)
    assert [strings[i] for i in order] == sorted(strings)

import random

import numpy as np
import xxhash

from cellkpi.llm import simhash_dedup as sd
from cellkpi.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, linked):
    """item -> least item reachable, by comparing all pairs."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in items}


def family(rng, count):
    """Fingerprints of a few families, chained by flips of up to five bits, and some alone."""
    out = [rng.getrandbits(64) for _ in range(count // 4)]
    while len(out) < count:
        fp = rng.choice(out)
        for bit in rng.sample(range(64), rng.randrange(1, 6)):
            fp ^= 1 << bit
        out.append(fp)
    return out


def check_links(spark, fps, groups, hot):
    unlike = sorted(set(fps))
    df = spark.createDataFrame([(sd._signed(f),) for f in unlike], "fp long")
    links = sd.grid_links(df, 4, groups, hot)
    got = {r.node: r.low for r in components(links).collect()}
    signed = [sd._signed(f) for f in unlike]
    mask = (1 << 64) - 1
    expected = plain_components(signed, lambda a, b: ((a ^ b) & mask).bit_count() <= 4)
    assert {x: got.get(x, x) for x in signed} == expected


def test_links_like_all_pairs(spark):
    for seed, groups in ((1, 6), (2, 5), (3, 8)):
        check_links(spark, family(random.Random(seed), 300), groups, 1000)


def test_dense_cells_by_midpoints(spark):
    check_links(spark, family(random.Random(4), 120), 6, 2)


def test_fingerprints_and_components(spark):
    rng = random.Random(5)
    words = [f"Wort{i}" for i in range(50)] + ["ÄÖ", "x"]
    texts = ["", None, " \n", "one", "one two three", "a b c d", "A B C d"]
    for _ in range(40):
        t = [rng.choice(words) for _ in range(rng.randrange(1, 200))]
        texts.append(" ".join(t))
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = "changed"
            texts.append("\n".join(t))
    docs = list(enumerate(texts)) + [(None, "one"), (3, "one")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sd.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    fps = {t: plain_fingerprint(t) for _, t in docs}
    linked = plain_components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for doc, text in docs:
        if doc is not None:
            root = linked[fps[text]]
            least[root] = min(doc, least.get(root, doc))
    expected = sorted((str(d), f"{fps[t]:016x}", least[linked[fps[t]]]) for d, t in docs)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows) == expected


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(5, text, 1), (2, text, 2), (7, "something else", 3), (None, text, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = sd.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.fp for r in kept.collect()) == [2, 3, 4]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, component_id long")
    assert sd.near_duplicates(df).collect() == []


def test_forest_contracts_as_it_goes():
    fp = np.arange(16, dtype=np.uint64)
    a, b = sd.forest(np.zeros(16, np.int64), fp, 1)
    assert len(a) == 15 and set(b.tolist()) == {0}

import random

import numpy as np
from pyspark.sql import functions as F

from cellkpi.llm import near_copies as nc
from tests.llm.test_simhash import plain_components

SCHEMA = "doc_id long, text string"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_groups(texts, similarity=0.8):
    """doc_id -> least id of its group, by comparing all pairs that share a shingle or have none."""
    sets = {d: plain_shingles(t) for d, t in texts.items()}

    def linked(a, b):
        return jaccard(sets[a], sets[b]) >= similarity

    return plain_components(sorted(texts), linked)


def edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def families(rng, count, length):
    """Texts in families; members differ from an earlier member in one or two words."""
    docs = []
    for _ in range(count):
        base = [[f"w{rng.randrange(10**6)}" for _ in range(length)]]
        for _ in range(rng.randrange(4)):
            base.append(edited(rng, rng.choice(base), max(1, length // 120)))
        docs += base
    rng.shuffle(docs)
    return {i: " ".join(words) for i, words in enumerate(docs)}


def kept(spark, texts, **limits):
    df = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(5)
    return {r.doc_id for r in nc.one_of_each_copy(df, **limits).collect()}


def test_families_like_all_pairs(spark):
    texts = families(random.Random(5), 60, 240)
    assert kept(spark, texts) == set(plain_groups(texts).values())
    # Buckets of several blocks give the same groups.
    assert kept(spark, texts, block=2) == set(plain_groups(texts).values())


def test_short_texts(spark):
    rng = random.Random(6)
    texts = {}
    for i in range(40):
        words = [f"s{i}x{k}" for k in range(30)]
        texts[3 * i] = " ".join(words)
        texts[3 * i + 1] = " ".join([*words, "tail"])  # 26 of 27 shingles
        texts[3 * i + 2] = " ".join(edited(rng, words, 6))
    assert kept(spark, texts) == set(plain_groups(texts).values())


def test_a_text_of_half_the_shingles_stays(spark):
    shared = " ".join(f"common{i}" for i in range(200))
    texts = {i: shared + " " + " ".join(f"own{i}x{k}" for k in range(100)) for i in range(60)}
    assert kept(spark, texts) == set(texts)


def test_recall_by_similarity():
    """The share of pairs at a similarity of 0.8 that share a sample and are near as a whole."""
    rng = np.random.default_rng(8)
    for size in (10, 45, 300, 2000):
        met, trials = 0, 200
        for _ in range(trials):
            union = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            out = rng.permutation(len(union))[: len(union) // 5]
            a = np.delete(union, out[: len(out) // 2])
            b = np.delete(union, out[len(out) // 2 :])
            near = np.bitwise_count(nc.simhash_rows(a[None])[0] ^ nc.simhash_rows(b[None])[0]) <= nc.FAR
            x, y = nc.sample_fingerprints(a), nc.sample_fingerprints(b)
            k = min(len(x), len(y))
            met += bool(near and (x[:k] == y[:k]).any())
        assert met / trials >= 0.95, (size, met / trials)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = " ".join(f"long{i}" for i in range(120_000))
    docs = [
        (4, "A b c D e f"), (4, "a B c d e f"), (None, "a b c d e f"), (9, ""), (None, None), (8, " \n"),
        (5, long), (6, long + " more"), (7, "one"), (3, "two"), (2, "One"),
    ]
    df = spark.createDataFrame(docs, SCHEMA)
    for c in ("__row", "node", "same", "key", "row", "root"):
        df = df.withColumn(c, F.lit("x"))
    out = nc.one_of_each_copy(df.repartition(3))
    assert out.columns == df.columns and all(r["__row"] == r.root == "x" for r in out.collect())
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 4, 5, 8]
    assert nc.one_of_each_copy(df.limit(0)).collect() == []


def test_a_candidate_of_many_is_split(spark):
    words = [f"hub{i}" for i in range(400)]
    texts = {0: " ".join(words)}
    for i in range(1, 1300):
        texts[i] = " ".join([*words, f"leaf{i}"])
    assert kept(spark, texts) == {0}


def test_the_nearest_is_not_the_only_partner(spark):
    """Each text of a pair at 0.8 has many nearer ones below 0.8, before it in every bucket that they share."""
    rng = random.Random(3)
    core = [f"core{i}" for i in range(204)]
    tail = [f"tail{i}" for i in range(27)]
    texts = {i: " ".join([*core, *(f"own{i}x{k}" for k in range(27))]) for i in range(150)}
    texts[200] = " ".join([*core, *tail])
    for i in range(201, 206):
        texts[i] = " ".join([*core, *tail[:2], *(f"own{i}x{rng.randrange(10**6)}" for _ in range(25))])
    groups = plain_groups(texts)
    assert groups[201] == groups[205] == 200 and len(set(groups.values())) == 151
    assert kept(spark, texts) == set(groups.values())
    assert kept(spark, texts, block=40) == set(groups.values())
    assert kept(spark, texts, block_bytes=1 << 16) == set(groups.values())


def test_all_groups_with_a_similar_pair_are_joined():
    rng = np.random.default_rng(4)
    for trial in range(30):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 40)), dtype=np.uint64))
        sets = []
        for _ in range(40):
            own = rng.integers(0, 1 << 63, int(rng.integers(0, 6)), dtype=np.uint64)
            sets.append(np.union1d(base[rng.random(len(base)) < rng.choice([0.85, 1])], own))
        node, block = rng.permutation(40), rng.integers(0, 2, 40)
        root = np.where(rng.random(40) < 0.3, node.min(), node)
        for across in (False, True):
            left, right = nc.similar_apart(node, root, block, sets, across, 0.8)
            at = {int(v): i for i, v in enumerate(node)}

            def linked(i, j):
                both = len(np.intersect1d(sets[i], sets[j]))
                near = both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
                return root[i] == root[j] or (near and not (across and block[i] == block[j]))

            expected = plain_components(range(40), linked)
            found = {(at[a], at[b]) for a, b in zip(left, right, strict=True)}
            assert all(linked(*pair) and root[pair[0]] != root[pair[1]] for pair in found)
            joined = plain_components(
                range(40), lambda i, j: root[i] == root[j] or (i, j) in found or (j, i) in found
            )
            assert joined == expected, trial

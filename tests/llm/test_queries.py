"""Registered queries against SQL, the operators' libraries and plain versions."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from parity import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cellkpi.llm import byte_pairs, line_quality, private_data, token_counts, tokenizing
from cellkpi.llm.queries import oracle_sql, queries
from tests.llm.test_near_copies import plain_groups

QUERIES = queries()
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts():
    """Texts of many scripts and odd ones, with their ids."""
    rng = random.Random(7)
    some = ["", None, " ", "<|endoftext|>", "a<|endoftext|> b", "a" * 3000 + "!" * 777, "\x00\x1c x"]
    some += [" \n\n  x", "don't we'll", "日本語 テスト ﷽ 𝟘 ١٢", "no_words here 1234567"]
    letters = "abc '\n\t<|>éß中1２½  \x85\x1c'llreve🙂"
    for _ in range(300):
        size = rng.randrange(60)
        wide = [chr(rng.randrange(0xE000, 0x11000)) for _ in range(3)]
        some.append("".join(rng.choice([*letters, *wide]) for _ in range(size)))
    some.append("long words and spaces " * 80_000)
    return list(enumerate(some))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, QUERIES[name], oracle_sql()[name]) == []


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", x)[1]) for x in QUERIES if x != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES


def test_token_counts_like_the_library(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(token_counts.count_tokens(spark.createDataFrame(texts, SCHEMA).repartition(3)))
    for doc, text in texts:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        r = got[doc]
        assert (r.n_bytes, r.n_tokens) == (len((text or "").encode()), n)
        assert r.over_limit == (n > 1024)


def test_ids_like_the_library_and_back(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    df = spark.createDataFrame(texts, SCHEMA).withColumn("ids", F.lit("x"))
    got = by_id(byte_pairs.encode_decode(df.repartition(3), with_ids=True))
    for doc, text in texts:
        ids = plain.encode_ordinary(text or "")
        r = got[doc]
        assert (r.ids or []) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_pieces_split_like_the_whole():
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", " ", "\n", "1", "é", "'s", "."]) for _ in range(3000))
    parts = list(tokenizing.pieces(text, 50))
    assert len(parts) > 10 and "".join(parts) == text
    assert [t for p in parts for t in tokenizing.split(p)] == tokenizing.split(text)


def plain_quality(text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
    symbols = len(re.findall("[#*$%&|<>]", text or ""))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    counts = (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside))
    return (*counts, failed)


def test_quality_counts_like_plain_python(spark, texts):
    rng = random.Random(4)
    more = [" ".join(rng.choice("abcde") for _ in range(n)) for n in range(0, 200, 7)]
    docs = texts + [(10_000 + i, t) for i, t in enumerate([*more, more[3], "a b c d e\n" * 9])]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("kept", F.lit("clash"))
    got = by_id(line_quality.quality_report(df))
    for doc, text in docs:
        r = got[doc]
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert (*counts, r.base_failed) == plain_quality(text)
        assert not (r.kept and r.base_failed)


def test_lines_fail_by_rule(spark):
    good = "A sentence of plain words that ends as it should, with more to say about nothing."
    good += " Another one follows it on this line so that most words of the whole text are kept."
    bad = ["Home | About | Help", "ALL!! OF!! THIS!!", "six words that never end here", "a# b# c#"]
    bad.append("Copyright 2020. All rights reserved.")
    docs = [(1, "\n".join([good, *bad, "A heading"]), "x"), (2, "\n".join(bad * 9), "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, __found string")
    report = by_id(line_quality.quality_report(df))
    assert report[1].n_failed_lines == len(bad) and report[1].n_lines == len(bad) + 2
    rows = line_quality.clean_documents(df).collect()
    assert [(r.doc_id, r.text, r["__found"]) for r in rows] == [(1, f"{good}\nA heading", "x")]


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        lambda m: all(int(x) <= 255 for x in m.split(".")),
    ),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        lambda m: 13 <= len(digits(m)) <= 19 and private_data.luhn(digits(m)),
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
}


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain_base(text):
    return {
        kind: [m.span() for m in re.finditer(pattern, text or "") if fits(m[0])]
        for kind, (pattern, fits) in BASE.items()
    }


def test_base_spans_like_plain_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@ -+()5b%2,\n4") for _ in range(rng.randrange(60)))
        assert private_data.base_spans(text) == plain_base(text)


def spans_of(text):
    return [x.split(":") for x in text.split(",") if x]


def test_contexts_find_unseen_identifiers(spark):
    docs = [(i, f"Please write to mail box user{i}@example.org or wait.") for i in range(12)]
    docs += [(100 + i, f"They write to mail box agent{i}x7 for help.") for i in range(3)]
    docs += [(200 + i, f"It was built in year {1900 + i} by hand.") for i in range(30)]
    docs += [(300, None), (301, ""), (0, docs[0][1])]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("kind", F.lit(1))
    rows = private_data.find_private(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = dict(docs)[r.doc_id] or ""
        base = plain_base(text)
        assert [r[f"n_{k}"] for k in base] == list(map(len, base.values()))
        named = ",".join(f"{k}:{b}:{e}" for k, spans in base.items() for b, e in spans)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        found = [(kind, text[int(b) : int(e)]) for kind, b, e in spans_of(r.spans)]
        if 100 <= r.doc_id < 200:
            assert found == [("email", f"agent{r.doc_id - 100}x7")]
        else:
            assert r.spans == named
    hidden = private_data.redact(df.dropDuplicates(["doc_id"]))
    assert hidden.columns == df.columns
    out = {r.doc_id: r.text for r in hidden.collect()}
    assert out[101] == "They write to mail box [EMAIL] for help."
    assert out[205] == docs[20][1] and out[300] is None


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, spans int")
    assert token_counts.count_tokens(df).collect() == []
    assert byte_pairs.encode_decode(df).collect() == []
    assert line_quality.quality_report(df).collect() == []
    assert private_data.find_private(df).collect() == []


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "private_data", "mixture", "encoding"]
    columns = docs.columns

    kept = {r.doc_id for r in line_quality.quality_report(docs).where("kept").collect()}
    first = stages["quality"](spark, docs, sf_dir)
    rows = by_id(first)
    assert first.columns == columns and set(rows) == kept
    assert all(r.n_chars == len(r.text) for r in rows.values())

    second = stages["near_dedup"](spark, first, sf_dir)
    least = set(plain_groups({d: r.text for d, r in rows.items()}).values())
    assert second.columns == columns and set(by_id(second)) == least

    third = by_id(stages["private_data"](spark, second, sf_dir))
    assert set(third) == least
    for d, r in third.items():
        assert not any(plain_base(r.text).values()) and ("[" in r.text or r.text == rows[d].text)

    last = by_id(corpus_pipeline.run(spark, sf_dir))
    assert last and set(last) <= set(third)
    for d, r in last.items():
        assert r.decoded_sha256 == hashlib.sha256(third[d].text.encode()).hexdigest()

"""Rows that are very long, and columns that are called like an operator's own."""

import time

from pyspark.sql import functions as F

from cellkpi.llm import common, mixture, private_data, transcripts
from cellkpi.llm.private_data import redact, replace_spans

CONVERSATIONS = "conv_id long, turn int, role string, text string"


def test_spans_are_replaced_in_one_pass():
    spans = [("email", 2, 4), ("phone", 3, 6), ("card", 6, 7), ("ip", 8, 8)]
    assert replace_spans("ab\U0001f642defghij", spans) == "ab[EMAIL][CARD]h[IP]ij"
    assert replace_spans("0123456789", [("email", 2, 4), ("phone", 3, 6), ("card", 6, 7)]) == (
        "01[EMAIL][CARD]789"
    )
    assert replace_spans("x", []) == "x"


def test_a_text_of_many_spans(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "a1@b.example or " * n)], "doc_id long, text string")
    begin = time.time()
    row = redact(docs.withColumns({"__row": F.lit(1), "__row_found": F.lit(2), "found": F.lit(3)})).first()
    assert row.text == "[EMAIL] or " * n
    assert (row["__row"], row["__row_found"], row.found) == (1, 2, 3)
    assert time.time() - begin < 60


def test_mixture_keeps_columns_called_like_its_own(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["__cell", "__Factor", "__mix", "factor", "tokens", "kept"]
    clashing = docs.withColumns({n: F.lit(n) for n in names})
    found = mixture.repeat_mixture(clashing)
    assert found.columns == clashing.columns
    rows = found.collect()
    assert rows and all(tuple(r)[-len(names) :] == tuple(names) for r in rows)
    plain = mixture.repeat_mixture(docs).select("doc_id").collect()
    assert sorted(r.doc_id for r in plain) == sorted(r.doc_id for r in rows)


def test_a_row_of_very_many_lines(spark):
    n = 200_000
    text = "\n".join(f"{'User' if i % 2 else 'Assistant'}: line {i}" for i in range(n))
    rows = [(1, 0, None, text), (2, 0, "user", "User: hello?"), (2, 1, "assistant", "Assistant: yes")]
    begin = time.time()
    found = transcripts.render_transcripts(spark.createDataFrame(rows, CONVERSATIONS))
    counts = {r.conv_id: r["n"] for r in found.groupBy("conv_id").agg(F.count("*").alias("n")).collect()}
    assert counts[1] == n and counts[2] == 2
    assert time.time() - begin < 120


def test_turn_numbers_with_gaps_fit_the_same_model(spark):
    told = [("user", "what is it?"), ("assistant", "a thing of some length"), ("user", "why?")] * 3
    models = []
    for step in (1, 10):
        rows = [(c, step * t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(told)]
        table = spark.createDataFrame(rows, CONVERSATIONS).repartition(4)
        lines = transcripts.lines_of(table, ("conv_id", "turn", "role", "text"))
        models.append(transcripts.fit(lines))
    assert repr(models[0]) == repr(models[1])


def test_redact_keeps_clashing_columns_null_texts_and_each_rows_own_spans(spark):
    rows = [
        (1, "write to a.b@example.org now", "x", 1, 5),
        (1, "call +1 202 555 1234 now", "y", 2, 6),
        (None, None, "z", 3, None),
        (None, "", None, 4, 8),
    ]
    schema = "doc_id long, text string, spans string, __row long, row long"
    docs = spark.createDataFrame(rows, schema)
    found = private_data.redact(docs)
    assert found.schema == docs.schema
    wanted = [(1, "write to [EMAIL] now", "x", 1, 5), (1, "call [PHONE] now", "y", 2, 6), *rows[2:]]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[3]) == wanted


def test_contexts_are_whole_words_up_to_the_span_before():
    long = "w" * 500
    assert private_data._context(f"a {long} code x1", 2 + 500 + 6, 2, 0) == f"{long} code"
    assert private_data._context("mail a@b.c or 17x4", 14, 2, 10) == "or"
    assert private_data._context("one\ntwo 17x4", 8, 2, 0) == "two"


def test_scratch_tables_of_a_stage_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_path", lambda _, name: str(tmp_path / name))
    made = common.stored_alone(lambda: common.stored(spark.range(9), "first").where("id > 3"), "second")
    assert made.count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["second"]

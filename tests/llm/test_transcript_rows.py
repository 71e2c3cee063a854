"""Rows of several lines come out whole, however they repeat and wherever a partition ends."""

from collections import Counter

import pytest

from cellkpi.llm import transcripts as tr

SCHEMA = "conv_id long, turn long, role string, text string"


def test_repeated_rows_of_several_lines(spark):
    rows = [(1, 0, "user", "Hi\nthere")] * 2 + [(1, 1, "assistant", "Yes\nno\nso")] * 3
    got = tr.render_transcripts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert Counter((r.turn, r.piece) for r in got) == {(0, 0): 2, (1, 0): 3}
    assert all(r.rendered.count("\n") == 4 + r.turn for r in got)


@pytest.mark.parametrize("partitions", [1, 61])
def test_range_boundaries_cut_no_row(spark, partitions):
    rows = [(7, t, "user", "\n".join(f"line {i} of {t}" for i in range(30))) for t in range(40)]
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = tr.render_transcripts(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.turn, r.piece) for r in got) == [(t, 0) for t in range(40)]
    texts = {t: text for _, t, _, text in rows}
    assert all(texts[r.turn] in r.rendered for r in got)

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cellkpi.llm import transcripts as tr

COLUMNS = ("conv_id", "turn", "role", "text")


def best_path(model, features, opens):
    """The best roles by trying all."""
    n = len(features)
    scores = [model.line(f) for f in features]
    best = None
    for path in itertools.product(range(len(tr.ROLES)), repeat=n):
        total = model.start[path[0]] + scores[0][path[0]]
        for i in range(1, n):
            step = model.across if opens[i] else model.within
            total += step[path[i - 1]][path[i]] + scores[i][path[i]]
        if best is None or total > best[0] + 1e-9:
            best = (total, path)
    return [tr.ROLES[i] for i in best[1]]


@pytest.mark.parametrize("part_lines", [10_000, 2])
def test_roles_like_trying_all_paths(spark, sf_dir, part_lines):
    rng = random.Random(1)
    rows = []
    for conv in [*range(8), None]:
        for turn in range(rng.randrange(1, 4)):
            marker = rng.choice(["", "", "User: ", "Assistant: ", "System: "])
            text = marker + "\n".join("x" * rng.randrange(0, 90) for _ in range(rng.randrange(1, 3)))
            rows.append((conv, turn, None, text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    known = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    model = tr.fit(tr.lines_of(known, COLUMNS))
    lines = tr.lines_of(df, COLUMNS)
    got = tr.recover_roles(lines, model, part_lines).collect()
    assert len(got) == lines.count()
    for conv in [*range(8), None]:
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.place)
        features = [tuple(r[f] for f in tr.FEATURES) for r in mine]
        assert [r.found for r in mine] == best_path(model, features, [r.opens for r in mine])


def test_held_out_accuracy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/conversations.parquet")
    model = tr.fit(tr.lines_of(table.where("conv_id % 4 <> 0"), COLUMNS))
    rest = table.where("conv_id % 4 = 0")
    rows = tr.render_transcripts(rest, model=model).where("piece = 0")
    right = rows.agg(F.avg((F.col("role") == F.col("found")).cast("int"))).first()[0]
    assert rows.count() == rest.count()
    assert right > 0.9


def test_turns_of_one_text_are_cut_at_markers(spark):
    text = "System: Be kind.\nUser: What is it?\nAnd why?\n**Assistant:** A thing.\nSo it is."
    rows = [(1, 0, None, text, "x"), (2, None, "odd", None, "x"), (2, 1, "user", "User:", "x")]
    df = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, line string"
    )
    got = sorted(tr.render_transcripts(df).collect(), key=lambda r: (r.conv_id, r.turn or 0, r.piece))
    assert [(r.conv_id, r.found) for r in got][:3] == [(1, "system"), (1, "user"), (1, "assistant")]
    assert got[1].rendered == "<|user|>\nWhat is it?\nAnd why?\n<|end|>\n"
    assert got[2].rendered == "<|assistant|>\nA thing.\nSo it is.\n<|end|>\n"
    assert len(got) == 5


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "Hi"), (1, 0, "user", "Hi")], "conv_id long, turn long, role string, text string"
    )
    assert tr.render_transcripts(df).count() == 2
    assert tr.render_transcripts(df.limit(0)).collect() == []

"""Recovering who speaks in transcripts with a hidden Markov model, and rendering their turns.

A transcript is a sequence of rows of text; each row's lines are observations, the speaker's role is
the hidden state. A line shows a speaker marker (such as ``User:``), its size, the size of its row,
whether it asks, and whether it opens the row or the transcript. Model counts come from rows with
known roles, over all of them, with a prior that lets markers name their role; a role given in the
data is used for the counts only, never for decoding. The most likely roles (Viterbi) are then found
and the turns written in one canonical form, without their markers.

Transcripts of any length are decoded in parts. Lines are sorted by range over the tasks, so a long
transcript covers several. Each task reduces its part of a transcript to the best score from every
state before it to every state at its end; these small matrices, one per part, are chained per
transcript; then each task decodes its part between its two fixed states. The result is that of one
pass over the whole.

A null text is an empty line, a null or unknown role gives no count, a null transcript id is a
transcript of its own, and rows without a turn number come first. Repeated rows are repeated turns.
Columns besides id, turn, role and text are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellkpi.llm.common import grouped_chunks, stored

# Roles, and the words that mark them at the start of a line.
ROLES = ("system", "user", "assistant", "tool")
MARKERS = {
    "system": "system",
    "instruction": "system",
    "instructions": "system",
    "user": "user",
    "human": "user",
    "customer": "user",
    "question": "user",
    "q": "user",
    "assistant": "assistant",
    "ai": "assistant",
    "bot": "assistant",
    "agent": "assistant",
    "answer": "assistant",
    "a": "assistant",
    "tool": "tool",
    "function": "tool",
    "observation": "tool",
}
MARKER = r"^[\x20\t>*#\[<|]*(?i:(" + "|".join(MARKERS) + r"))[\]>|*]*[\x20\t]*:[*]*[\x20\t]*"
FEATURES = ("marker", "line_size", "row_size", "asks")
SMOOTHING, MARKER_WEIGHT = 0.5, 1000.0


@dataclass(frozen=True)
class Model:
    """Log probabilities; ``emissions``: per feature, value -> one number per role."""

    start: list[float]
    across: list[list[float]]
    within: list[list[float]]
    emissions: dict[str, dict[str, list[float]]]
    unseen: dict[str, list[float]]

    def line(self, features: tuple[str, ...]) -> list[float]:
        total = [0.0] * len(ROLES)
        for name, value in zip(FEATURES, features, strict=True):
            scores = self.emissions[name].get(value, self.unseen[name])
            total = [a + b for a, b in zip(total, scores, strict=True)]
        return total


def lines_of(conversations: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """A row per line: conv_id, turn, role, row_id, line number, text, features, whether it opens.

    ``opens`` is true for a row's first line and for a line with a marker. ``row_id`` is one number
    for all lines of an input row and no other; it holds once the lines are stored.
    """
    conv, turn, role, text = columns
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.lower(role).alias("role"),
        F.coalesce(text, F.lit("")).alias("whole"),
    ).withColumns({"row": F.xxhash64("whole"), "row_id": F.monotonically_increasing_id()})
    lines = rows.select(
        "*", F.posexplode(F.split("whole", "\n")).alias("line", "text")
    ).withColumn("row_size", _size(F.length("whole"))).drop("whole")
    word = F.lower(F.regexp_extract("text", MARKER, 1))
    names = F.create_map(*(F.lit(x) for pair in MARKERS.items() for x in pair))
    marker = F.coalesce(F.try_element_at(names, word), F.lit("none"))
    return lines.withColumns(
        {
            "marker": marker,
            "line_size": _size(F.length("text")),
            "asks": F.rtrim("text").endswith("?").cast("string"),
            "opens": (F.col("line") == 0) | (marker != "none"),
        }
    )


def _size(length: Column) -> Column:
    return F.floor(F.log2(length + 1)).cast("string")


def fit(lines: DataFrame) -> Model:
    """The model of all lines with a known role.

    What reaches the driver are counts per role and feature value: a few hundred numbers for any
    input, for sizes are logarithms and markers a fixed list.
    """
    known = lines.where(F.col("role").isin(list(ROLES)))
    shown = F.explode(
        F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES))
    )
    counts = known.select("role", shown.alias("x")).groupBy("role", "x").count().collect()
    rows = known.where("line = 0").groupBy("conv_id", "turn", "row", "role").count()
    # The role before a row is that of the turn before it. A transcript's rows meet by (id, turn), not
    # by id alone, so that a long one is spread over tasks.
    before = rows.select("conv_id", F.col("turn").alias("previous"), F.col("role").alias("before"))
    pairs = rows.select("conv_id", "turn", "role").join(_previous_turns(rows), ["conv_id", "turn"], "left")
    pairs = pairs.join(before.distinct(), ["conv_id", "previous"], "left")
    steps = pairs.groupBy("before", "role").count().collect()

    n = len(ROLES)
    at = {role: i for i, role in enumerate(ROLES)}
    seen: dict[str, dict[str, np.ndarray]] = {f: {} for f in FEATURES}
    for role, x, count in counts:
        seen[x["f"]].setdefault(x["v"], np.zeros(n))[at[role]] += count
    for role in ROLES:  # a marker names its role even where the data has none
        seen["marker"].setdefault(role, np.zeros(n))[at[role]] += MARKER_WEIGHT
    seen["marker"].setdefault("none", np.zeros(n))
    emissions, unseen = {}, {}
    for f, values in seen.items():
        total = sum(values.values(), np.zeros(n)) + SMOOTHING * (len(values) + 1)
        if f == "marker":  # the prior must not make lines without a marker look odd
            total = np.maximum(total - MARKER_WEIGHT, MARKER_WEIGHT)
        emissions[f] = {v: np.log((c + SMOOTHING) / total).tolist() for v, c in values.items()}
        unseen[f] = np.log(SMOOTHING / total).tolist()
    start, across = np.full(n, SMOOTHING), np.full((n, n), SMOOTHING)
    for b, role, count in steps:
        if b is None:
            start[at[role]] += count
        else:
            across[at[b], at[role]] += count
    across = np.log(across / across.sum(axis=1, keepdims=True))
    within = np.log(np.where(np.eye(n, dtype=bool), 1 - 1e-6 * (n - 1), 1e-6))
    return Model(
        np.log(start / start.sum()).tolist(), across.tolist(), within.tolist(), emissions, unseen
    )


class _Part:
    """The lines of one transcript in one task."""

    def __init__(self, model: Model, columns: dict[str, list], begin: int, end: int):
        self.model = model
        features = zip(*(columns[f][begin:end] for f in FEATURES), strict=True)
        memo: dict[tuple, list[float]] = {}
        self.scores = [memo.get(x) or memo.setdefault(x, model.line(x)) for x in features]
        self.steps = [model.across if o else model.within for o in columns["opens"][begin:end]]

    def decode(self, entry: list[float]) -> tuple[list[float], list[list[int]]]:
        """Scores of the states at the end and the best predecessors, from scores before the part."""
        states = range(len(ROLES))
        now, back = entry, []
        for score, step in zip(self.scores, self.steps, strict=True):
            best = [max(states, key=lambda i, j=j: now[i] + step[i][j]) for j in states]
            now = [now[best[j]] + step[best[j]][j] + score[j] for j in states]
            back.append(best)
        return now, back

    def first(self) -> tuple[list[float], list[list[int]]]:
        """Like ``decode`` for a part that begins its transcript."""
        states = range(len(ROLES))
        start = [self.model.start[j] + self.scores[0][j] for j in states]
        rest = _Part.__new__(_Part)
        rest.model, rest.scores, rest.steps = self.model, self.scores[1:], self.steps[1:]
        now, back = rest.decode(start)
        return now, [[0] * len(ROLES), *back]


def _walk(back: list[list[int]], last: int) -> list[int]:
    path = [last]
    for best in reversed(back[1:]):
        path.append(best[path[-1]])
    return path[::-1]


NEVER = -1e300


def _matrix(part: _Part, opens_transcript: bool) -> list[float]:
    """Best scores from each state before the part (one row if there is none) to each at its end."""
    if opens_transcript:
        return part.first()[0]
    out: list[float] = []
    for i in range(len(ROLES)):
        out += part.decode([0.0 if k == i else NEVER for k in range(len(ROLES))])[0]
    return out


def _previous_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, previous): the turn number before each one in its transcript, gaps or not.

    Turns are dealt into ranges, so a transcript may lie in several. Within a range the window looks one
    turn back; the first turn of a range follows the last one of the transcript's range before.
    """
    dealt = rows.select("conv_id", "turn").distinct().repartitionByRange("conv_id", "turn")
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), "turns")
    in_part = Window.partitionBy("conv_id", "part").orderBy("turn")
    own = dealt.withColumn("own", F.lag("turn").over(in_part))
    lasts = dealt.groupBy("conv_id", "part").agg(F.max("turn").alias("last"))
    over_parts = Window.partitionBy("conv_id").orderBy("part")
    lasts = lasts.select("conv_id", "part", F.lag("last").over(over_parts).alias("carried"))
    joined = own.join(lasts, ["conv_id", "part"])
    return joined.select("conv_id", "turn", F.coalesce("own", "carried").alias("previous"))


def _parts(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.Table, list]]:
    """Tables of whole parts, and the part bounds in each: (begin, end, part)."""
    for table in grouped_chunks(batches, "part", 20_000):
        columns = {f: table.column(f).to_pylist() for f in (*FEATURES, "opens")}
        name = table.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(name)) + 1).tolist(), len(name)]
        bounds = zip(cuts, cuts[1:], strict=False)
        yield table, [(b, e, _Part(model, columns, b, e)) for b, e in bounds]


def recover_roles(lines: DataFrame, model: Model, part_lines: int = 10_000) -> DataFrame:
    """``lines`` with ``found``, the most likely role of each."""
    # The given role only decides between rows of one text, so that ids, which depend on how the
    # input is partitioned, change no result.
    order = ["conv_id", "turn", "row", "role", "row_id", "line"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    # A part is the stretch of one transcript within one task, cut again every part_lines lines.
    place = F.monotonically_increasing_id()
    placed = stored(ranged.withColumn("place", place), "lines")
    slot = F.shiftright("place", 33) * (1 << 33) + F.floor(F.col("place") % (1 << 33) / part_lines)
    placed = placed.withColumn("part", F.xxhash64("conv_id", slot)).withColumn("slot", slot)
    dealt = lambda: placed.repartition("part").sortWithinPartitions("part", "place")

    heads = placed.groupBy("conv_id").agg(F.min("place").alias("head"))
    spans = placed.groupBy("conv_id", "part").agg(F.min("place").alias("first"))
    spans = spans.withColumn("known", F.lit(1))
    joined = spans.join(heads, spans["conv_id"].eqNullSafe(heads["conv_id"])).select(
        "part", "first", spans["conv_id"], (F.col("first") == F.col("head")).alias("opening")
    )
    openings = stored(joined, "parts")

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, parts in _parts(batches, model):
            names = [table.column("part")[b].as_py() for b, _, _ in parts]
            whole = [_matrix(p, True) for _, _, p in parts]
            free = [_matrix(p, False) for _, _, p in parts]
            kind = pa.list_(pa.float64())
            yield pa.record_batch(
                [pa.array(names), pa.array(whole, kind), pa.array(free, kind)],
                ["part", "opened", "carried"],
            )

    needed = dealt().select("part", *FEATURES, "opens")
    matrices = needed.mapInArrow(reduce, "part long, opened array<double>, carried array<double>")
    fixed = chain(stored(openings.join(matrices, "part"), "matrices"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, parts in _parts(batches, model):
            roles: list[str] = []
            before, after = table.column("before"), table.column("after")
            for b, _, part in parts:
                entry, last = before[b].as_py(), after[b].as_py()
                if entry is None:
                    back = part.first()[1]
                else:
                    back = part.decode([0.0 if k == entry else NEVER for k in range(len(ROLES))])[1]
                roles += [ROLES[i] for i in _walk(back, last)]
            out = table.append_column("found", pa.array(roles, pa.string()))
            yield from out.drop_columns(["before", "after"]).combine_chunks().to_batches()

    columns = ["conv_id", "turn", "role", "row_id", "line", "text", *FEATURES, "opens"]
    columns += ["place", "part"]
    ready = placed.select(*columns).join(fixed, "part").select(*columns, "before", "after")
    ready = ready.repartition("part").sortWithinPartitions("part", "place")
    kinds = dict(ready.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", found string"
    return ready.mapInArrow(decode, schema).drop("part")


def chain(matrices: DataFrame) -> DataFrame:
    """(part, before, after): the states just before and at the end of each part on the best path.

    A transcript's parts are chained in a task of its own; each is a few numbers for thousands of
    lines.
    """
    rows = matrices.select(
        F.xxhash64(F.lit(0), F.col("conv_id").isNull(), "conv_id").alias("name"),
        "part",
        "first",
        "opened",
        "carried",
        "opening",
    )
    rows = rows.repartition("name").sortWithinPartitions("name", "first")
    n = len(ROLES)

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_chunks(batches, "name", 20_000):
            parts = table.column("part").to_pylist()
            opening = table.column("opening").to_pylist()
            opened = np.array(table.column("opened").to_pylist())
            carried = np.array(table.column("carried").to_pylist()).reshape(-1, n, n)
            heads = [*(i for i, x in enumerate(opening) if x), len(parts)]
            before: list[int | None] = [None] * len(parts)
            after = [0] * len(parts)
            for b, e in zip(heads, heads[1:], strict=False):
                now, back = opened[b], []
                for i in range(b + 1, e):
                    total = now[:, None] + carried[i]
                    back.append(total.argmax(axis=0))
                    now = total.max(axis=0)
                state = int(now.argmax())
                for i in range(e - 1, b, -1):
                    after[i] = state
                    state = before[i] = int(back[i - b - 1][state])
                after[b] = state
            columns = [pa.array(parts), pa.array(before, pa.int32()), pa.array(after, pa.int32())]
            yield pa.record_batch(columns, ["part", "before", "after"])

    return rows.mapInArrow(link, "part long, before int, after int")


def render_transcripts(
    conversations: DataFrame,
    columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"),
    model: Model | None = None,
    part_lines: int = 10_000,
) -> DataFrame:
    """A row per recovered turn: conv_id, turn, piece, role given, role found, rendered text.

    A turn is a run of lines of one row, cut where a marker stands or the role changes; ``piece``
    numbers the turns of a row. Without a ``model`` one is fitted to the rows with roles.
    """
    lines = stored(lines_of(conversations, columns), "observed")
    found = recover_roles(lines, model or fit(lines), part_lines)
    found = stored(found, "found")
    # A range boundary may fall inside a row, so the row's id alone tells which lines belong together.
    body = F.regexp_replace("text", MARKER, "").alias("body")
    in_row = Window.partitionBy("row_id").orderBy("line")
    cut = F.col("opens") | (F.lag("found").over(in_row) != F.col("found"))
    before = in_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A row's first line begins its first turn, number 0, whatever it is.
    fresh = F.when(F.row_number().over(in_row) == 1, 0).otherwise(cut.cast("int"))
    cuts = found.withColumn("fresh", fresh)
    turns = cuts.select("*", F.sum("fresh").over(before).cast("int").alias("piece"), body)
    held = turns.groupBy("conv_id", "turn", "role", "row_id", "piece").agg(
        F.first("found").alias("found"),
        F.sort_array(F.collect_list(F.struct("line", "body"))).alias("lines"),
    )
    whole = F.array_join(F.transform("lines", lambda x: x["body"]), "\n")
    text = F.concat(F.lit("<|"), "found", F.lit("|>\n"), F.trim(whole), F.lit("\n<|end|>\n"))
    return held.select("conv_id", "turn", "piece", "role", "found", text.alias("rendered"))

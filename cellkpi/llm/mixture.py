"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token shares are raked: scaled to
the target share of each source, then of each language, then of each topic, and again until a round
moves none by more than a tolerance. A cell's factor is its fitted share over the share it has. A
document is kept with the calibrated chance ``min(1, scale * factor)``; kept documents of cells that
would need more than all their documents carry the rest as ``weight``, so that weighted tokens meet
the targets. ``repeat_mixture`` repeats such documents instead, so that plain tokens meet them too.
Whether a document is kept depends on the hash of its id alone, so it repeats.

Documents are added up to cells before anything is shuffled, and cells are joined back to documents
by Spark's own choice: a broadcast only if their size allows, otherwise a join whose frequent cells
are split. Cells, as many as combinations occur, go through the rounds as tables in the shared
scratch folder.

The topic of a document is the form of its text unless the caller gives a column. A null source,
language or topic is a category of its own, as is an empty one together with it. Without targets a
margin is tempered: the shares are raised to a power below one and normalised, which lifts rare
categories. A category without a target, or with target zero, is left out; targets of categories
without tokens fall to the others. Contradicting targets end after ``rounds``. A null or empty text
has no tokens, and a cell without tokens keeps its documents at factor 1. Rows that repeat an id, or
have none, share a fate. ``sample_mixture`` and ``repeat_mixture`` keep all columns; ``mixing_report`` ignores columns it
does not need, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellkpi.llm.common import free_name, stored

MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mixture:
    """``targets``: wanted shares by margin, then category; a margin left out is tempered."""

    targets: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    temper: float = 0.7
    scale: float = 1.0
    rounds: int = 30
    tolerance: float = 1e-6
    seed: int = 11


def text_form(text: Column) -> Column:
    """What kind of text it is, by its size, lines and marks: a rough topic that needs no model."""
    size = F.length(text)
    lines = F.regexp_count(text, F.lit("\n")) + 1
    bars = F.regexp_count(text, F.lit(r"\|"))
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(bars * 40 > size, "table")
        .when(size < 400, "note")
        .when(size < 120 * lines, "list")
        .when(size < 4000, "article")
        .otherwise("long")
    )


def token_weight(text: Column) -> Column:
    """Tokens of a text, taken as a quarter of its bytes: a weight, no exact count."""
    return F.coalesce(F.octet_length(text) / 4, F.lit(0.0))


def _cells(documents: DataFrame, margins: Mapping[str, Column], weight: Column) -> DataFrame:
    named = documents.select(
        *(_category(column).alias(name) for name, column in margins.items()), weight.alias("w")
    )
    return named.groupBy(*margins).agg(F.sum("w").alias("tokens"))


def _category(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def target_shares(cells: DataFrame, margin: str, mixture: Mixture) -> DataFrame:
    """(margin, share) of the categories that occur with tokens; the shares add up to one."""
    held = cells.groupBy(margin).agg(F.sum("tokens").alias("held")).where("held > 0")
    targets = mixture.targets.get(margin)
    if targets is None:
        wanted = held.select(margin, F.pow("held", F.lit(mixture.temper)).alias("want"))
    else:
        rows = [(str(name), float(share)) for name, share in targets.items() if share > 0]
        listed = cells.sparkSession.createDataFrame(rows, f"{margin} string, want double")
        wanted = held.join(listed, margin).select(margin, "want")
    total = wanted.agg(F.sum("want")).first()[0] or 1.0
    return wanted.select(margin, (F.col("want") / total).alias(f"{margin}_share"))


def rake(cells: DataFrame, mixture: Mixture) -> DataFrame:
    """``cells`` (margins..., tokens) with ``factor``: fitted share over present share."""
    margins = cells.columns[:-1]
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    current = cells.withColumn("fitted", F.col("tokens") / total)
    for margin in margins:
        current = current.join(target_shares(cells, margin, mixture), margin, "left")
    current = stored(current.fillna(0.0, [f"{m}_share" for m in margins]), "cells")
    names = [*cells.columns, "fitted", *(f"{m}_share" for m in margins)]
    for _ in range(mixture.rounds):
        moved = F.lit(0.0)
        for margin in margins:
            sums = current.groupBy(margin).agg(F.sum("fitted").alias("sum"))
            scale = F.when(F.col("sum") > 0, F.col(f"{margin}_share") / F.col("sum"))
            current = current.join(sums, margin).withColumn("scale", F.coalesce(scale, F.lit(0.0)))
            live = F.when(F.col("fitted") > 0, F.abs(F.col("scale") - 1)).otherwise(0.0)
            current = current.withColumns(
                {"moved": F.greatest(moved, live), "fitted": F.col("fitted") * F.col("scale")}
            ).drop("sum", "scale")
            moved = F.col("moved")
        current = stored(current, "cells")
        most = current.agg(F.max("moved")).first()[0]
        current = current.select(*names)
        if most is None or most <= mixture.tolerance:
            break
    factor = F.when(F.col("tokens") > 0, F.col("fitted") * total / F.col("tokens")).otherwise(1.0)
    return current.select(*cells.columns, factor.alias("factor"))


def _uniform(mixture: Mixture, id_column: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(mixture.seed), id_column), 11) / float(1 << 53)


def _drawn(
    documents: DataFrame, mixture: Mixture, topic: Column | None, id_column: str, text_column: str
) -> tuple[DataFrame, str, str]:
    """(rows with a struct and a factor added, the struct's name, the factor's name).

    The struct has the categories, tokens, chance, weight and whether the row is kept. Names are such that
    ``documents`` has no column called so.
    """
    text = F.col(text_column)
    margins = {
        "source": F.col("source"),
        "lang": F.col("lang"),
        "topic": text_form(text) if topic is None else topic,
    }
    cells = stored(_cells(documents, margins, token_weight(text)), "cells")
    fitted = rake(cells, mixture).drop("tokens")
    cell_name, factor, mix_name = (free_name(documents, x) for x in ("__cell", "__factor", "__mix"))
    fitted = fitted.select(F.struct(*MARGINS).alias(cell_name), F.col("factor").alias(factor))
    fitted = stored(fitted, "factors")
    cell = F.struct(*(_category(column).alias(name) for name, column in margins.items()))
    joined = documents.withColumn(cell_name, cell).join(fitted, cell_name)
    wanted = F.col(factor) * mixture.scale
    uniform = _uniform(mixture, id_column)
    chance = F.least(wanted, F.lit(1.0))
    mix = F.struct(
        *(F.col(cell_name)[name].alias(name) for name in MARGINS),
        token_weight(text).alias("tokens"),
        chance.alias("chance"),
        F.greatest(wanted, F.lit(1.0)).alias("weight"),
        (uniform < chance).alias("kept"),
    )
    return joined.withColumn(mix_name, mix), mix_name, factor


def mixing_report(
    documents: DataFrame,
    mixture: Mixture = Mixture(),
    topic: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per document: id, source, lang, topic, tokens, chance, weight and ``kept``."""
    drawn, mix, _ = _drawn(documents, mixture, topic, id_column, text_column)
    return drawn.select(F.col(id_column).alias("doc_id"), f"{mix}.*")


def sample_mixture(
    documents: DataFrame,
    mixture: Mixture = Mixture(),
    topic: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The kept documents, each once, with their own columns.

    Cells that would need more than all their documents miss their targets by their ``weight``;
    ``repeat_mixture`` repeats documents instead.
    """
    drawn, mix, _ = _drawn(documents, mixture, topic, id_column, text_column)
    return drawn.where(F.col(mix)["kept"]).select(*documents.columns)


def repeat_mixture(
    documents: DataFrame,
    mixture: Mixture = Mixture(),
    topic: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The documents, each as often as its cell needs, with their own columns.

    ``scale * factor`` is the expected number of copies: the whole part of it are certain, one more
    is drawn with the rest as its chance. So the expected tokens of every cell are the fitted ones.
    """
    drawn, _, factor = _drawn(documents, mixture, topic, id_column, text_column)
    wanted = F.col(factor) * mixture.scale
    more = (_uniform(mixture, id_column) < wanted - F.floor(wanted)).cast("int")
    copies = F.floor(wanted).cast("int") + more
    each = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))
    return drawn.select(F.struct(*documents.columns).alias("doc"), each).select("doc.*")

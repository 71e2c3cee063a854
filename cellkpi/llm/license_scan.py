"""License scans by ordered signature rules.

A text becomes lower-case words. Rules (``license_rules``) are gated by their first word: only where such
a keyword stands are the rules that begin with it held against the words from there on, anchored, so that
a rule costs nothing in texts without its keyword and every place is tried. What rules find are intervals
of words, and overlapping ones are resolved. *Containment*: an interval inside another one of the same or
a higher level goes; of equal ones the higher level stays, then the earlier rule. *Priority*: what is left
goes if it overlaps one of a higher level. Labels are those of the intervals that stay, besides the base
phrases' labels, which always count. The score is the largest weight among them.

Everything is built from DataFrame functions. A first pass reads the texts once and stores what it found
(whole numbers, no texts); windows over that, a sort by place within each row, resolve overlaps with
running extremes, so a row of many intervals costs no pairs and may spill. Groups are single documents.

Null and empty texts have no words: counts are zero, first and last words null, labels empty and the score
zero. Repeated rows, null and repeated ids give a row each. Columns besides the id and the text are
ignored, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellkpi.llm.common import let, stored
from cellkpi.llm.license_rules import BASE, BASE_WEIGHT, SIGNATURE_LIST, SPAN, WEIGHTS, Signature

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases come first and have level 0; a rule is known by its place in this list.
RULES = [Signature(label, 0, said.split(" ")[0], said) for said, label in BASE] + SIGNATURE_LIST
TOP = max(WEIGHTS)
FOUND = "array<struct<rule:int,start:int,stop:int>>"


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, with A to Z in lower case."""
    lower = F.translate(F.coalesce(text, F.lit("")), LETTERS, LETTERS.lower())
    return F.array_remove(F.split(lower, BETWEEN), "")


def _rules_by_keyword() -> Column:
    """A constant map from keyword to the rules that begin with it."""
    numbered = sorted(enumerate(RULES), key=lambda x: (x[1].keyword, x[0]))
    entries = []
    for keyword, rules in groupby(numbered, key=lambda x: x[1].keyword):
        some = [
            F.struct(F.lit(i).alias("rule"), F.lit(f"^({r.pattern})(?: |$)").alias("pattern"))
            for i, r in rules
        ]
        entries += [F.lit(keyword), F.array(*some)]
    return F.create_map(*entries)


def _found(said: Column) -> Column:
    """The intervals that rules find in an array of words, by place."""
    keywords = sorted({r.keyword for r in RULES})

    def at(place: Column) -> Column:
        def held(ahead: Column) -> Column:
            def matched(rule: Column) -> Column:
                text = F.call_function("regexp_extract", ahead, rule.pattern, F.lit(1))
                blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
                stop = let(text, lambda x: F.when(x != "", place + blanks(x) + 1))
                return F.struct(rule.rule.alias("rule"), place.alias("start"), stop.alias("stop"))

            rules = F.element_at(_rules_by_keyword(), F.get(said, place))
            return F.filter(F.transform(rules, matched), lambda x: x.stop.isNotNull())

        # Single items, as slice() copies the whole array; items past the end are null and left out.
        ahead = F.array(*(F.get(said, place + k) for k in range(SPAN)))
        return let(F.array_join(ahead, " "), held)

    marked = F.transform(said, lambda w, i: F.when(w.isin(keywords), i))
    places = F.filter(marked, lambda i: i.isNotNull())
    return F.flatten(F.transform(places, at)).cast(FOUND)


def _by_rule(values: list, rule: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), rule + 1)


def scan(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, id, n_words, found) of every document, stored; ``row`` tells the rows apart."""
    taken = let(
        words(F.col(text_column)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _found(w).alias("found")),
    )
    read = docs.select(F.col(id_column).alias("id"), taken.alias("taken"))
    row = F.monotonically_increasing_id().alias("row")
    return stored(read.select(row, "id", "taken.n_words", "taken.found"), "licenses")


def resolved(places: DataFrame) -> DataFrame:
    """Intervals (row, rule, start, stop, level) that neither containment nor priority removes."""
    order = [F.col("start"), F.desc("stop"), F.desc("level"), F.col("rule")]
    back = [F.desc("start"), F.col("stop"), F.col("level"), F.desc("rule")]
    by_row, earlier = Window.partitionBy("row"), (Window.unboundedPreceding, -1)
    before = by_row.orderBy(*order).rowsBetween(*earlier)
    after = by_row.orderBy(*back).rowsBetween(*earlier)  # frames that look ahead cost pairs
    levels = sorted(WEIGHTS)

    def reach(least: int) -> Column:
        """The furthest end of an earlier interval of the level or a higher one."""
        return F.max(F.when(F.col("level") >= least, F.col("stop"))).over(before)

    def own(columns: str, over: int = 0) -> Column:
        """The column of the row's own level, of those made per level."""
        chosen = F.lit(None).cast("int")
        for level in levels:
            if level + over <= TOP:
                chosen = F.when(F.col("level") == level, F.col(f"{columns}{level + over}")).otherwise(chosen)
        return chosen

    reached = places.withColumns({f"reach{k}": reach(k) for k in levels})
    held = F.coalesce(own("reach") >= F.col("stop"), F.lit(False))
    outer = reached.where(~held).drop(*(f"reach{k}" for k in levels))
    nearest = {
        f"next{k}": F.min(F.when(F.col("level") >= k, F.col("start"))).over(after) for k in levels
    }
    beside = outer.withColumns({f"reach{k}": reach(k) for k in levels} | nearest)
    beaten = (own("reach", 1) > F.col("start")) | (own("next", 1) < F.col("stop"))
    return beside.where(~F.coalesce(beaten, F.lit(False))).select(*places.columns)


def find_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per document.

    ``spans`` are the intervals that count, base phrases included, as (label, level, start, stop) in
    words; ``first_word`` and ``last_word`` are the least and largest start of a base phrase.
    """
    read = scan(docs, id_column, text_column)
    each = read.select("row", F.explode("found").alias("at")).select("row", "at.*")
    each = each.withColumn("level", _by_rule([r.level for r in RULES], F.col("rule")))
    base = each.where(F.col("level") == 0)
    kept = base.unionByName(resolved(each.where(F.col("level") > 0)))
    label = _by_rule([r.label for r in RULES], F.col("rule"))
    weight = _by_rule([WEIGHTS.get(r.level, BASE_WEIGHT) for r in RULES], F.col("rule"))
    span = F.struct("start", "stop", "level", label.alias("label"))
    of_base = F.col("level") == 0
    marks = kept.groupBy("row").agg(
        F.count(F.when(of_base, 1)).alias("n_base"),
        F.min(F.when(of_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(of_base, F.col("start"))).cast("long").alias("last_word"),
        F.collect_set(F.when(of_base, label)).alias("base_labels"),
        F.collect_set(label).alias("labels"),
        F.max(weight).alias("score"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    joined = read.drop("found").join(marks, "row", "left")
    text = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit("")).alias(c)
    empty = F.array().cast(kept.select(F.array(span)).schema[0].dataType)
    return joined.select(
        "id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        text("base_labels"),
        text("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", empty).alias("spans"),
    )


def license_query(docs: DataFrame) -> DataFrame:
    return find_licenses(docs).drop("spans").withColumnRenamed("id", "doc_id")

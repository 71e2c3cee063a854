"""Line-first cleaning: rules drop lines, then documents that lost too much text are rejected.

Every line with a word is held against three rules. *Punctuation*: the line has symbols or doubled
exclamation marks for a third of its words or more, or ends no sentence although it has six words or
more. *Navigation*: a third of its words or more are bare separators. *Boilerplate*: it has a legal
or site phrase. Failing lines go. A document is kept if it passes two counts over its whole text
(enough words, few repeated five-word windows) and its remaining lines hold enough of its words.

Everything is built from DataFrame functions over arrays within a row: nothing is shuffled and no
Python runs on executors. Windows are compared by their 64-bit hashes within one document.

A null text has no words, so it fails; so does an empty one. Repeated rows give repeated rows.
Columns besides the id and the text are kept by ``clean_documents`` and ignored by
``quality_report``, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellkpi.llm.common import let

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MARKS = rf"{SYMBOLS}|!!"
SOME_MARK = r"[#*$%&|<>!]"
SENTENCE_END = r"[.!?:;…。！？]"
# The same with the danda and the marks of Arabic, Urdu, Armenian, Ethiopic, Khmer, Burmese, Tibetan.
ANY_SENTENCE_END = SENTENCE_END[:-1] + "।॥؟۔؛։՞՜።፧፨។៕။།༎｡．：；]"
SEPARATORS = r"[|>»•·/–-]"
SEPARATOR_WORDS = rf"(?<![^\x20\x09-\x0D]){SEPARATORS}(?![^\x20\x09-\x0D])"
WINDOW = 5

# Phrases of legal and site boilerplate.
BOILERPLATE = [
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "powered by",
    "subscribe to our",
    "sign up for our",
    "released under the",
    "licensed under",
    "javascript is disabled",
    "enable javascript",
]


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; the shares are in percent, as whole numbers.

    ``phrase_chars``: longer lines are no boilerplate, whatever they say; none means no limit.
    ``sentence_end`` is a pattern.
    """

    least_words: int = 10
    most_repeated: int = 20
    line_symbols: int = 33
    line_separators: int = 33
    unended_words: int = 6
    least_kept_words: int = 50
    phrase_chars: int | None = None
    sentence_end: str = SENTENCE_END


# Rules for text that may be one long line, or of any script. The query op1 keeps those of its SQL.
WIDE = Rules(phrase_chars=200, sentence_end=ANY_SENTENCE_END)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _covered(windows: Column) -> Column:
    """Words within windows whose hash occurs twice or more, from all windows' hashes in order."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(ordered: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            before = F.get(ordered, j - 1)["h"] == x["h"]
            after = F.get(ordered, j + 1)["h"] == x["h"]
            return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), x["i"])

        return F.sort_array(F.array_compact(F.transform(ordered, twin)))

    def length(begin: Column) -> Column:
        step = F.transform(
            begin,
            lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(begin, j + 1) - x, F.lit(WINDOW))),
        )
        return F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x)

    return let(let(placed, starts), length)


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of five words that occur twice or more."""
    none = F.lit(0).cast("long")

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.slice(hashes, 1, F.size(hashes) - (WINDOW - 1)),
            lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, WINDOW))),
        )

    def count(found: Column) -> Column:
        unlike = F.size(F.array_distinct(found)) == F.size(found)
        return F.when(unlike, none).otherwise(_covered(found))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    counted = let(let(hashes, windows), count)
    return F.when(F.size(words) < WINDOW, none).otherwise(counted)


def judged_line(line: Column, rules: Rules) -> Column:
    """A struct of a line, its words and whether it breaks a rule."""

    def phrase(lower: Column) -> Column:
        found = F.lit(False)
        for text in BOILERPLATE:
            found = found | lower.contains(text)
        return found

    def judge(n: Column) -> Column:
        # Most lines have none of these; finding that out is cheaper than counting.
        marks = F.when(line.rlike(SOME_MARK), F.regexp_count(line, F.lit(MARKS))).otherwise(0)
        bars = F.when(line.rlike(SEPARATORS), F.regexp_count(line, F.lit(SEPARATOR_WORDS)))
        bars = bars.otherwise(0)
        short = F.lit(True)
        if rules.phrase_chars is not None:
            short = F.length(line) <= rules.phrase_chars
        fails = (
            (100 * marks >= rules.line_symbols * n)
            | (100 * bars >= rules.line_separators * n)
            | ((n >= rules.unended_words) & ~line.rlike(rules.sentence_end))
            | (short & let(F.lower(line), phrase))
        )
        return F.struct(line.alias("line"), n.alias("n"), fails.alias("fails"))

    return let(F.size(words_of(line)), judge)


def measured(text: Column, rules: Rules) -> Column:
    """A struct of all counts, the cleaned text and the verdict for one text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    long = lambda c: c.cast("long")

    def counts(words: Column, lines: Column, good: Column) -> Column:
        n = long(F.size(words))
        kept_words = F.aggregate(good, F.lit(0).cast("long"), lambda total, x: total + x["n"])
        return F.struct(
            n.alias("n_words"),
            long(F.length(F.array_join(words, ""))).alias("word_chars"),
            long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            long(F.size(lines)).alias("n_lines"),
            long(F.size(lines) - F.size(good)).alias("n_failed_lines"),
            kept_words.alias("n_kept_words"),
            F.array_join(good["line"], "\n").alias("clean_text"),
        )

    def with_lines(words: Column) -> Column:
        return let(
            lines,
            lambda found: let(
                F.filter(F.transform(found, lambda x: judged_line(x, rules)), lambda x: ~x["fails"]),
                lambda good: counts(words, found, good),
            ),
        )

    return let(words_of(text), with_lines)


def _judged(documents: DataFrame, text: Column, rules: Rules, name: str) -> DataFrame:
    """``documents`` with the struct ``name`` of counts and the two verdicts.

    The struct comes out of a generator of one row, so that a condition on it is not pushed below,
    where all of it would be computed again for each field that the condition reads.
    """

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < rules.least_words) | (
            100 * m["n_repeat_words"] > rules.most_repeated * m["n_words"]
        )
        enough = 100 * m["n_kept_words"] >= rules.least_kept_words * m["n_words"]
        return m.withField("base_failed", failed).withField("kept", ~failed & enough)

    found = F.transform(F.array(measured(text, rules)), verdict)
    return documents.select("*", F.explode(found).alias(name))


def quality_report(
    documents: DataFrame,
    rules: Rules = Rules(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per document: id, counts, ``base_failed`` and ``kept``."""
    texts = documents.select(
        F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text")
    )
    judged = _judged(texts, F.col("text"), rules, "found")
    return judged.select(
        "doc_id",
        *(
            F.col("found")[name].alias(name)
            for name in (
                "n_words",
                "word_chars",
                "n_symbols",
                "n_dup_lines",
                "n_repeat_words",
                "n_lines",
                "n_failed_lines",
                "n_kept_words",
                "base_failed",
                "kept",
            )
        ),
    )


def clean_documents(
    documents: DataFrame, rules: Rules = Rules(), text_column: str = "text"
) -> DataFrame:
    """The kept documents, with their failed lines and wordless lines removed from the text."""
    name = "__found"
    while name in documents.columns:
        name += "_"
    judged = _judged(documents, F.coalesce(text_column, F.lit("")), rules, name)
    kept = judged.where(F.col(name)["kept"])
    return kept.withColumn(text_column, F.col(name)["clean_text"]).drop(name)

"""Personal data by patterns, and by contexts that bootstrapping learns from what patterns found.

Base spans (emails, addresses, cards, phones) come from fixed grammars. They are the seeds: the
words just before a seed form its lexical context. All identifier-like words of the corpus, seeds or
not, form a graph of contexts and instances, which Spark scores in rounds. A context belongs to one
class of instances (with letters, dotted, long or short numbers). Its confidence is the share of its
instances' weight that is trusted for one kind. A seed is trusted; another instance is as trusted as
the accepted contexts other than this one together make it, so no context lends itself trust.
Contexts above a confidence and support are accepted, and mark unseen identifiers after them. Only counts per (context, instance) are shuffled, never texts; tables of a
round are written to the shared scratch folder.

A null text is empty and an empty one has no spans. Repeated rows count as evidence each and give
repeated rows. Columns besides the id and the text are kept by ``redact`` and ignored by
``find_private``, whatever they are called. The id need not be unique.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellkpi.llm.common import free_name, sized_slices, stored

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int]

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# A number of so many digits may be a phone or a card; years, prices and the like are shorter.
LONG_NUMBER = 9

# An identifier-like word: four characters or more with a digit or an at sign, less the
# punctuation around it.
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_WHITE = " \t\n\x0b\x0c\r"
_BLANK = _WHITE.replace("\n", "")
_EDGE = "\"'.,;:!?()[]{}<>*#$%&|=`"
_HAS_MARK = re.compile(r"[0-9@]")


@dataclass(frozen=True)
class Bootstrap:
    """Limits of the context search.

    ``context_words`` words before an identifier form its context. A context is used if its
    confidence reaches ``confidence`` over at least ``support`` different instances, and if at
    least ``seeds`` of these are base spans of one kind. ``rounds`` rounds are scored.
    """

    context_words: int = 2
    confidence: float = 0.6
    support: int = 4
    seeds: int = 3
    rounds: int = 3


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in time linear in the text.

    The search starts at the at signs; the local part is what precedes one, up to the last match.
    """
    found: list[Span] = []
    bound = 0
    for match in _AT.finditer(text):
        begin = match.start()
        while begin > bound and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < match.start():
            found.append((begin, match.end()))
            bound = match.end()
    return found


def addresses(text: str) -> list[Span]:
    fits = (m for m in _IP.finditer(text))
    return [m.span() for m in fits if all(_byte(part) for part in m[0].split("."))]


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") < 256


def cards(text: str) -> list[Span]:
    found = []
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 13:
            digits = _NOT_DIGIT.sub("", match[0])
            if len(digits) <= 19 and len(digits) >= 13 and luhn(digits):
                found.append(match.span())
    return found


def phones(text: str) -> list[Span]:
    matches = _PHONE.finditer(text)
    return [m.span() for m in matches if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: FINDERS[kind](text) for kind in KINDS}


def form(instance: Column) -> Column:
    """The class of identifiers that are comparable: a context of one says nothing of another."""
    numbers = F.regexp_count(instance, F.lit("[0-9]"))
    return (
        F.when(instance.rlike(r"[\p{L}@]"), "word")
        .when(instance.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "dotted")
        .when(numbers >= LONG_NUMBER, "long")
        .otherwise("short")
    )


def _context(text: str, before: int, words: int, bound: int) -> str:
    """The last ``words`` lower-cased words before a place on its line, less edge marks.

    Words are whole, however long, but none reaches back over ``bound``, the end of the base span before.
    """
    found: list[str] = []
    at = before
    while len(found) < words:
        while at > bound and text[at - 1] in _BLANK:
            at -= 1
        end = at
        while at > bound and text[at - 1] not in _WHITE:
            at -= 1
        if at == end:
            break
        found.append(text[at:end].strip(_EDGE).lower())
    return " ".join(found[::-1])


def identifiers(text: str, base: dict[str, list[Span]], words: int) -> list[tuple]:
    """Identifier-like places: (kind or None, start, end, context, instance)."""
    found = []
    taken = sorted((b, e, kind) for kind, spans in base.items() for b, e in spans)
    begins = [b for b, _, _ in taken]
    reach: list[int] = []
    for _, end, _ in taken:
        reach.append(max(end, reach[-1]) if reach else end)
    for i, (b, e, kind) in enumerate(taken):
        bound = min(b, reach[i - 1]) if i else 0
        found.append((kind, b, e, _context(text, b, words, bound), text[b:e]))
    for match in _marked_tokens(text):
        core = match[0].strip(_EDGE)
        if len(core) < 4 or not _HAS_MARK.search(core):
            continue
        b = match.start() + match[0].index(core)
        e = b + len(core)
        before = bisect_right(begins, e - 1)
        if before and reach[before - 1] > b:
            continue  # touches a base span
        bound = reach[before - 1] if before else 0
        found.append((None, b, e, _context(text, b, words, bound), core))
    return found


def _marked_tokens(text: str) -> Iterator[re.Match]:
    """The words with a digit or an at sign, found without looking at every word."""
    at = 0
    while (mark := _HAS_MARK.search(text, at)) is not None:
        begin = mark.start()
        while begin > at and text[begin - 1] not in _WHITE:
            begin -= 1
        match = _TOKEN.match(text, begin)
        yield match
        at = match.end()


def _spans_text(base: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{b}:{e}" for kind in KINDS for b, e in base[kind])


SCAN_SCHEMA = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<kind:string,begin:int,end:int>>, "
    "places array<struct<kind:string,begin:int,end:int,context:string,instance:string>>"
)


def scan(documents: DataFrame, limits: Bootstrap, with_text: bool = False) -> DataFrame:
    """Base spans and identifier-like places of every document (doc_id, text); ``with_text`` keeps the text.

    ``doc_id`` may have any type: ``redact`` puts a struct of the row's other columns there.
    """
    kind = T.StructType([documents.schema["doc_id"]])
    words = limits.context_words
    span = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])
    place = pa.struct(
        [*span, pa.field("context", pa.string()), pa.field("instance", pa.string())]
    )
    names = ("kind", "begin", "end", "context", "instance")

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, 1):
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            hashes, spans, places = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                for k in KINDS:
                    counts[k].append(len(base[k]))
                hashes.append(hashlib.sha256(_spans_text(base).encode()).hexdigest())
                spans.append(
                    [{"kind": k, "begin": b, "end": e} for k in KINDS for b, e in base[k]]
                )
                found = identifiers(text, base, words)
                places.append([dict(zip(names, x, strict=True)) for x in found])
            texts = [batch.column(1)] if with_text else []
            yield pa.record_batch(
                [
                    batch.column(0),
                    *(pa.array(counts[k], pa.int64()) for k in KINDS),
                    pa.array(hashes, pa.string()),
                    pa.array(spans, pa.list_(span)),
                    pa.array(places, pa.list_(place)),
                    *texts,
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "places"]
                + ["text"] * with_text,
            )

    columns = T.StructType.fromDDL(SCAN_SCHEMA + ", text string" * with_text)
    return documents.mapInArrow(find, T.StructType([*kind.fields, *columns.fields]))


def learn_contexts(scanned: DataFrame, limits: Bootstrap) -> DataFrame:
    """The trusted contexts: (context, form, kind), from rounds over the context-instance graph.

    The instance's form is part of its context, so that a context found by phones does not mark
    years. In the first round only seeds are trusted; later ones add what accepted contexts mark,
    each context scored without its own share in that.
    """
    places = scanned.select(F.explode("places").alias("p")).select("p.*").where("context <> ''")
    known = F.max("kind").alias("seed")
    edges = places.groupBy("context", form(F.col("instance")).alias("form"), "instance").agg(known)
    edges = stored(edges, "edges")
    # Only contexts that some seed has can gain trust.
    by_kind = edges.where("seed is not null").groupBy("context", "form", "seed")
    seeded = by_kind.agg(F.count("*").alias("seeds")).where(F.col("seeds") >= limits.seeds)
    seeded = seeded.withColumnRenamed("seed", "kind").drop("seeds")
    graph = stored(edges.join(seeded, ["context", "form"]), "graph")
    is_seed = F.col("seed") == F.col("kind")
    good = (F.col("confidence") >= limits.confidence) & (F.col("support") >= limits.support)
    accepted = None
    for _ in range(limits.rounds):
        # Logarithm of the doubt that an accepted context leaves; zero for all others.
        doubted = graph.withColumn("doubt", F.lit(0.0))
        if accepted is not None:
            doubt = F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence")))
            lent = accepted.select("context", "form", "kind", doubt.alias("doubt"))
            doubted = graph.join(lent, ["context", "form", "kind"], "left").fillna(0.0, ["doubt"])
        sums = doubted.groupBy("instance", "kind").agg(
            F.sum("doubt").alias("all_doubt"), F.max(F.coalesce(is_seed, F.lit(False))).alias("sure")
        )
        others = F.greatest(F.lit(0.0), 1 - F.exp(F.col("all_doubt") - F.col("doubt")))
        trust = F.when(F.col("sure"), 1.0).otherwise(others)
        scored = doubted.join(sums, ["instance", "kind"]).groupBy("context", "form", "kind")
        contexts = scored.agg(F.avg(trust).alias("confidence"), F.count("*").alias("support"))
        accepted = stored(contexts.where(good), "contexts")
    return accepted.select("context", "form", "kind")


def find_private(
    documents: DataFrame,
    limits: Bootstrap = Bootstrap(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per document: base counts, ``base_sha256``, and ``spans``, base and learned together.

    ``found`` holds the same spans as an array of (kind, begin, end), in code points, end exclusive.
    """
    texts = documents.select(
        F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text")
    )
    scanned = stored(scan(texts, limits).withColumn("row", F.monotonically_increasing_id()), "scan")
    joined = scanned.drop("places").join(_added(scanned, limits), "row", "left").drop("row")
    return joined.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        "base_sha256",
        _found().alias("found"),
    ).withColumn("spans", F.array_join(F.transform("found", _named), ","))


def _added(scanned: DataFrame, limits: Bootstrap) -> DataFrame:
    """(row, added): the spans that learned contexts add, of the rows that have some."""
    contexts = learn_contexts(scanned, limits)
    loose = scanned.select("row", F.explode("places").alias("p")).select("row", "p.*")
    loose = loose.where("kind is null and context <> ''").drop("kind")
    marked = loose.withColumn("form", form(F.col("instance"))).join(contexts, ["context", "form"])
    # A place that contexts of two kinds mark gets the first kind as listed.
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    once = marked.groupBy("row", "begin", "end").agg(F.min_by("kind", order).alias("kind"))
    return once.groupBy("row").agg(
        F.collect_list(F.struct("kind", "begin", "end")).alias("added")
    )


def _found() -> Column:
    none = F.array().cast("array<struct<kind:string,begin:int,end:int>>")
    return _in_order(F.concat("base", F.coalesce("added", none)))


def _named(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["begin"].cast("string"), span["end"].cast("string"))


def _in_order(spans: Column) -> Column:
    """The spans by kind as listed, then by start."""
    kinds = F.array(*map(F.lit, KINDS))

    def keyed(span: Column) -> Column:
        at = F.array_position(kinds, span["kind"])
        return F.struct(at.alias("at"), span["begin"].alias("begin"), span.alias("span"))

    return F.transform(F.sort_array(F.transform(spans, keyed)), lambda x: x["span"])


def redact(
    documents: DataFrame,
    limits: Bootstrap = Bootstrap(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``documents`` with every span of the text replaced by its kind, such as ``[EMAIL]``.

    Each row keeps its text beside its own spans through the scan: ``id_column`` is not read, so ids may
    repeat or be null. Only spans that contexts add are joined, by a stored row number. They are written
    first, so Spark knows their size: below its broadcast limit texts are not shuffled.
    """
    others = [F.col(c) for c in documents.columns if c != text_column]
    rest = F.struct(F.lit(True).alias(free_name(documents, "__row")), *others)
    texts = documents.select(rest.alias("doc_id"), F.col(text_column).alias("text"))
    numbered = scan(texts, limits, True).withColumn("row", F.monotonically_increasing_id())
    scanned = stored(numbered, "scan")
    added = stored(_added(scanned, limits), "added")
    joined = scanned.join(added, "row", "left").select("doc_id", "text", _found().alias("found"))
    some = F.size("found") > 0
    # Texts without spans are not sent to Python again.
    hidden = _replaced(F.when(some, F.col("text")), F.when(some, F.col("found")))
    text = F.when(some, hidden).otherwise(F.col("text"))
    columns = [
        text.alias(c) if c == text_column else F.col("doc_id")[c].alias(c) for c in documents.columns
    ]
    return joined.select(*columns)


def replace_spans(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """``text`` with spans (kind, begin, end) replaced by their kinds, in one pass over both.

    Spans begin in the text's code points; one that overlaps an earlier one that counts is left out.
    """
    parts, at = [], 0
    for begin, end, kind in sorted((b, e, k) for k, b, e in spans):
        if begin >= at:
            parts += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


@F.pandas_udf(T.StringType())
def _replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans, strict=True):
        known = text is not None and found is not None
        out.append(replace_spans(text, ((x["kind"], x["begin"], x["end"]) for x in found)) if known else text)
    return pd.Series(out, dtype=object)

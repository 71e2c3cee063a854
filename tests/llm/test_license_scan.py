import re

import pytest
from pyspark.sql import functions as F

from cellkpi.llm import license_scan as scan
from cellkpi.llm.license_rules import BASE, BASE_WEIGHT, SIGNATURE_LIST, SPAN, WEIGHTS

SCHEMA = "doc_id long, text string"


def plain(text):
    """The digest of one text, pair by pair."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for number, rule in enumerate(scan.RULES):
        for i, w in enumerate(words):
            if w == rule.keyword:
                m = re.match(f"({rule.pattern})(?: |$)", " ".join(words[i : i + SPAN]))
                if m:
                    found.append((number, rule, i, i + len(m[1].split(" "))))
    base = [f for f in found if f[1].level == 0]
    rest = [f for f in found if f[1].level]

    def inside(p, q):
        same = (p[2], p[3]) == (q[2], q[3])
        if q[1].level < p[1].level or not (q[2] <= p[2] and p[3] <= q[3]):
            return False
        return not same or (q[1].level, -q[0]) > (p[1].level, -p[0])

    outer = [p for p in rest if not any(inside(p, q) for q in rest)]
    kept = [
        p for p in outer
        if not any(q[1].level > p[1].level and q[2] < p[3] and p[2] < q[3] for q in outer)
    ]
    starts = [b[2] for b in base]
    weights = [WEIGHTS.get(f[1].level, BASE_WEIGHT) for f in base + kept]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({b[1].label for b in base})),
        ",".join(sorted({f[1].label for f in base + kept})),
        max(weights, default=0.0),
    )


TEXTS = [
    None,
    "",
    " .,;",
    "Licensed under the Apache License, Version 2.0 (the License)",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. cc by cc by CC-BY",
    "Released under the MIT License. All rights reserved. ALL RIGHTS RESERVED!",
    "SPDX-License-Identifier: GPL-2.0-or-later\nSPDX-License-Identifier: unheard",
    "Er kam mit dem Zug; l'apache und die lizenz",
    "GNU Lesser General Public License as published by the Free Software Foundation; version 2.1",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/ or http://www.gnu.org/licenses/old-licenses/gpl-2.0.html",
    "licensed under the very odd public license of mine, general public license v3 or later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "ＭＩＴ License, Ünlicense unlicense © 2019 2021 copyright (c) 2020",
    "all rights\x85reserved all\x7frights\x00reserved",
]


def test_like_a_plain_scan(spark):
    rows = list(enumerate(TEXTS)) + [(1000, " ".join(map(str, TEXTS)) * 40), (None, TEXTS[3]), (3, TEXTS[3])]
    table = spark.createDataFrame(rows, SCHEMA)
    found = scan.license_query(table.withColumns({"row": F.lit(0), "rule": F.lit("x"), "label": F.lit("y")}))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert scan.license_query(table.limit(0)).collect() == []


def test_spans_and_resolution(spark):
    text = "x licensed under the GNU General Public License version 3 y"
    row = scan.find_licenses(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert [(s.start, s.stop, s.level, s.label) for s in row.spans] == [
        (1, 10, 3, "gpl-3.0"),
        (5, 8, 0, "gpl"),
    ]
    assert (row.labels, row.score, row.base_labels) == ("gpl,gpl-3.0", 1.0, "gpl")


def test_a_long_text_of_many_licenses(spark):
    n = 60_000
    table = spark.createDataFrame([(1, "mit license and apache 2.0, cc by " * n)], SCHEMA)
    row = scan.license_query(table).first()
    assert (row.n_words, row.n_base, row.last_word) == (8 * n, n, 8 * n - 2)
    assert row.labels == "apache-2.0,cc-by,mit"


@pytest.mark.parametrize("rule", SIGNATURE_LIST, ids=lambda r: r.pattern[:30])
def test_rules_are_well_formed(rule):
    assert rule.keyword and rule.level in WEIGHTS
    assert re.match(re.escape(rule.keyword), rule.pattern)
    assert not re.search(r"\*|\+(?!\))|\{\d+,\}", rule.pattern.replace("[^ ]+", ""))
    assert len(rule.pattern.split(" ")) <= SPAN


def test_phrases_of_the_base():
    assert [said for said, _ in BASE] == ["cc by", "general public license", "all rights reserved"]

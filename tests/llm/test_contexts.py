"""Contexts of few seeds, or of another form of identifier, mark nothing."""

from cellkpi.llm import private_data
from tests.llm.test_queries import SCHEMA, plain_base


def test_thirty_percent_seeds_mark_no_ordinary_identifiers(spark):
    docs = [(i, f"Please quote the code user{i}@example.org here.") for i in range(12)]
    docs += [(100 + i, f"Please quote the code ab{i}x9 here.") for i in range(28)]
    docs += [(200 + i, f"You can call us at +1 202 555 {1000 + i} now.") for i in range(12)]
    docs += [(300 + i, f"You can call us at {1990 + i} now.") for i in range(4)]
    # A context with seven seeds in ten marks the rest.
    docs += [(400 + i, f"They write to mail box user{i}@example.com now.") for i in range(7)]
    docs += [(500 + i, f"They write to mail box agent{i}x7 now.") for i in range(3)]
    for r in private_data.find_private(spark.createDataFrame(docs, SCHEMA)).collect():
        text = dict(docs)[r.doc_id]
        found = [text[x.begin : x.end] for x in r.found]
        base = [text[b:e] for spans in plain_base(text).values() for b, e in spans]
        assert found == ([f"agent{r.doc_id - 500}x7"] if r.doc_id >= 500 else base)

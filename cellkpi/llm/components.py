"""Connected components of an edge table by alternating stars, one shuffle pair per step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellkpi.llm.common import stored


def _nearest(edges: DataFrame, both_ways: bool) -> DataFrame:
    """(node, other, low) for each edge of a node, with the least of the node and its neighbours."""
    if both_ways:
        turned = edges.select(F.col("low").alias("node"), F.col("node").alias("low"))
        edges = edges.unionAll(turned)
    edges = edges.select("node", F.col("low").alias("other"))
    # Written first: a join with an aggregate over the same shuffle isn't split where a node has very many edges.
    least = stored(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("low")), "least")
    return edges.join(least, "node")


def large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of its neighbourhood."""
    found = _nearest(edges, both_ways=True).where("other > node")
    return found.select(F.col("other").alias("node"), "low").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    found = _nearest(edges, both_ways=False)
    out = found.where("other > low").select(F.col("other").alias("node"), "low")
    return out.unionAll(found.select("node", "low")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, low): the least node of the component of every node that isn't it.

    ``edges`` has two columns of one ordered type; direction, loops and repeats don't matter.
    Rounds go on until one changes nothing; their number grows with the logarithm of the longest
    chain. Each round's table is written to the shared scratch folder.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("node"), F.least(a, b).alias("low")
    )
    current = stored(pairs.distinct(), "edges")
    mark = None
    while True:
        sums = F.struct(
            F.count("*"), F.bit_xor(F.xxhash64("node", "low")), F.bit_xor(F.xxhash64("low", "node"))
        )
        now = current.agg(sums).first()[0]
        if now == mark or now[0] == 0:
            return current
        mark = now
        halfway = stored(large_star(current), "edges")
        current = stored(small_star(halfway), "edges")

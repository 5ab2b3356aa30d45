"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from murmullo.session import materialize

MOST_ROUNDS = 60


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of ``links`` (a, b).

    Alternating large and small stars: every round hangs a node's larger neighbours, then its smaller
    ones, under the smallest, and stops when no edge changes. Each half round is a minimum per node and
    a join; tables are written to the shared folder in between, so both sides of a join are plain scans
    and a node with very many links is a skewed key that the join can split. Links of a node to itself
    and nulls are ignored; without links the result is empty.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct(), "links")
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        both = materialize(edges.union(edges.select("v", "u")), "links")
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "links")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least.select("u", "m")).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components need more than {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima and two joins, so a node with very many
neighbours is a skewed join key that adaptive execution splits, never a
collected group. Rounds are materialised in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longdoc.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(low, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(low, "a")
    return (linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))))


def _down(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller id, each once."""
    return (edges.where(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``edges`` (a long, b long) -> (node, component): every node that has an
    edge, with the smallest node reachable from it. Self-loops and repeated
    edges don't matter; an empty table gives an empty result."""
    cur = materialize(_down(edges), "edges")
    state = _state(cur)
    for _ in range(rounds):
        if not state[0]:
            break
        nxt = materialize(_down(_small_star(_down(_large_star(cur)))), "edges")
        new = _state(nxt)
        cur, done, state = nxt, new == state, new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # a settled table is a forest of stars: every larger node points at its root
    return (cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(cur.select("b", "b").distinct()))

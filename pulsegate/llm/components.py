"""Connected components of a graph whose edges are a table; only counts reach the driver.

Large-star and small-star steps in turn: each node's larger neighbours, then its smaller ones, are tied to
the smallest node it sees, until every component is a star around its smallest node. The number of rounds
grows with the logarithm of the longest path.

Every step is written to the shared folder. So executors may be lost, and each join reads two plain shuffles,
which adaptive execution splits where one node has very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import store

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    folded = F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), folded).head())


def _star(pairs: DataFrame, centre: DataFrame, own: bool) -> DataFrame:
    """pairs (u, v) and the smallest neighbour m of each u: every v tied to m, and with `own` u too, once."""
    ties = pairs.join(centre, "u").select(F.col("v").alias("hi"), F.least("m", "u").alias("lo"))
    if own:
        ties = ties.union(centre.select(F.col("u").alias("hi"), F.least("m", "u").alias("lo")))
    return ties.filter("hi <> lo").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a and b (long). node, root: every node that has an edge to another, and the smallest node of its component."""
    now = store(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "edges")
    state = _state(now)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        # Large star: of all neighbours, the larger ones go to the smallest.
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        centre = store(both.groupBy("u").agg(F.min("v").alias("m")), "centres")
        large = store(_star(both.filter("v > u"), centre, own=False), "large-star")
        # Small star: the smaller neighbours and the node itself go to the smallest of them.
        small = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        centre = store(small.groupBy("u").agg(F.min("v").alias("m")), "centres")
        now = store(_star(small, centre, own=True), "small-star")
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()

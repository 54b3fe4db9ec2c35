"""Connected components of a table of links, by alternating large and small stars.

Every round makes each node's larger neighbours point to its least one, then each node and its smaller neighbours
to their least: links of a component turn into a star around its least node in a number of rounds that grows with
the logarithm of its size.  Nothing but two sums per round reaches the driver.  Each node's least neighbour is written
before it is joined: both sides of the join are then dealt out as they are, and adaptive execution can split the
links of a node with very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

MOST_ROUNDS = 60


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) for every node of a link (a, b) to another; component is its least node.  a and b: not null."""
    edges = work.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = work.table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = work.table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return work.table(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _state(edges: DataFrame) -> tuple:
    mixed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mixed).first())

"""Connected components of a graph held as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriquill.llm.common import cut, merged

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge (a, b), the smallest node of its component.

    Each round hangs neighbours on the smallest node seen; it takes few rounds even for long chains. Minima are combined
    before the shuffle, and no list of neighbours is gathered, so a node with very many of them is no special case
    (adaptive execution splits its rows in the join). Every round ends in a checkpoint. An empty table gives an empty one.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size, before = now.count(), None
    rounds = 0
    while size:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        both, least = merged(size, both, least)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        large, down = merged(size, large, down)
        small = large.join(down, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = cut(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        # the sum runs over hashes, so equal sums of different edge sets do not happen in practice
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
        if state == before:
            break
        before, rounds = state, rounds + 1
        if rounds > MOST_ROUNDS:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

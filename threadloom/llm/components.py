"""Connected components of an edge table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import written

#: Edges from which on the rounds join sorted tables. Roots repeat, so stars of millions of nodes fill a
#: few megabytes on storage, and Spark would broadcast them by that size.
SORTED_EDGES = 1 << 16


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends."""
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")


def _met(left: DataFrame, right: DataFrame, key: str, many: bool) -> DataFrame:
    return left.hint("merge").join(right.hint("merge"), key) if many else left.join(right, key)


def _large_star(edges: DataFrame, many: bool = False) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("least"))
    return _met(around.where(F.col("v") > F.col("u")), least, "u", many).select(F.col("least").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame, many: bool = False) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    moved = _met(edges, least, "b", many).where(F.col("a") != F.col("least")).select(F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("least").alias("a"), "b"))


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node reachable from it.

    Alternating stars: each round links larger neighbours to the smallest one and shortens paths, so
    the number of rounds grows with the logarithm of the longest path. Every round is a table in the
    shared folder; minima combine before the shuffle, and joins against one row per node leave hot
    nodes to adaptive splitting. Ends when a round changes nothing. Loops and repeated edges are
    ignored; null ends are not nodes.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = written(edges.where(F.col("a") != F.col("b")).select(low, high).distinct(), "edges")
    before = None
    while True:
        # The sum of ends falls until the stars stand, so equal sums and counts mean no change.
        state = now.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before, many = state, state[0] >= SORTED_EDGES
        now = written(_small_star(_large_star(now, many), many).distinct(), "edges")
    roots = now.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)

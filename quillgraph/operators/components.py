"""Connected components by large-star and small-star contraction, for nodes of any ordered type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.scratch import discard, materialize

#: Edges from which on nodes of many edges are joined apart from the others, and the share of all edges that makes a node hot.
SPLIT_EDGES, HOT_SHARE = 200_000, 1 / 1000


def _least_neighbours(edges: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """edges(a, b) with m, the value of their a in least(a, m, n). Few edges: least is broadcast (at most one row an edge).
    Else the nodes with over a thousandth of all edges (at most 2,000 of them) are broadcast, so that no task gets all edges
    of a hot node, and the others are shuffled."""
    if count <= SPLIT_EDGES:
        return edges.join(F.broadcast(least.drop("n")), "a")
    hot = least.where(F.col("n") > max(int(count * HOT_SHARE), 1)).drop("n")
    apart = edges.join(F.broadcast(hot), "a")
    return edges.join(F.broadcast(hot.select("a")), "a", "left_anti").join(least.drop("n"), "a").unionByName(apart)


def components(links: DataFrame, name: str) -> DataFrame:
    """Connected components of links(a, b): node, root (the smallest node of its component). Nodes without links are absent.

    Alternates large-star and small-star steps, a few rounds even for long chains; each round is written to the shared folder, and
    hot nodes are handled by aggregate and join rather than by collecting neighbours.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    before, count = None, edges.count()
    while count:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _least_neighbours(both, low, 2 * count).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        star = _least_neighbours(large, least, 2 * count)
        after = star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")
        after = materialize(after.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
        state = tuple(after.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())
        discard(edges)
        edges, count = after, state[0]
        if state == before:
            break
        before = state
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

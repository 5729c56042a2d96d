"""Compact graphs and ranked routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.edges import degrees, window_rank
from quillgraph.sources.scratch import materialize


def _with_offsets(near: DataFrame) -> DataFrame:
    """near (node, degree) with offset, the sum of the degrees of all lower nodes: block totals first, so that no task sums all nodes."""
    near = near.withColumn("_block", F.floor(F.col("node") / 4096))
    blocks = near.groupBy("_block").agg(F.sum("degree").alias("_total"))
    blocks = blocks.withColumn("_start", F.sum("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).select("_block", F.coalesce("_start", F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("degree").over(Window.partitionBy("_block").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return near.withColumn("_in", inside).join(blocks, "_block").withColumn("offset", (F.col("_start") + F.col("_in")).cast("long")).drop("_block", "_in", "_start")


def csr(edges: DataFrame) -> DataFrame:
    """Compressed adjacency: node, offset into the neighbour array, degree, sorted neighbours (as text)."""
    near = edges.groupBy(F.col("artist_a_id").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.array_join(F.transform(F.sort_array(F.collect_list("artist_b_id")), lambda x: x.cast("string")), ",").alias("neighbours"))
    return _with_offsets(near).select("node", "offset", "degree", "neighbours")


def csr_failures(graph: DataFrame) -> DataFrame:
    """What is wrong with a compressed adjacency (failure, node), each rule a set operation over all nodes: nodes that come twice,
    degrees and offsets that do not add up, neighbours that are unsorted, repeated, unknown, the node itself or without a way
    back, and anchors (negative nodes) beside each other. A sound graph gives no rows."""
    g = graph.select("node", "offset", "degree", F.transform(F.filter(F.split(F.coalesce("neighbours", F.lit("")), ","), lambda x: x != ""), lambda x: x.cast("long")).alias("near"))
    g = materialize(g, "csr")
    said = lambda df, why: df.select(F.lit(why).alias("failure"), "node")
    slots = g.select("node", F.explode("near").alias("to")).distinct()
    back = slots.select(F.col("to").alias("node"), F.col("node").alias("to"))
    once = g.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("degree").alias("degree"), F.min("offset").alias("said"))
    return (
        said(once.where("n > 1"), "node comes twice")
        .unionByName(said(g.where(F.col("degree") != F.size("near")), "degree is not the number of neighbours"))
        .unionByName(said(_with_offsets(once.select("node", "degree", "said")).where("offset <> said"), "offset is not the sum of the degrees before"))
        .unionByName(said(g.where(F.col("near") != F.sort_array(F.array_distinct("near"))), "neighbours are not sorted and distinct"))
        .unionByName(said(slots.where("node = to"), "node is its own neighbour"))
        .unionByName(said(slots.join(g.select(F.col("node").alias("to")).distinct(), "to", "left_anti"), "neighbour is no node"))
        .unionByName(said(slots.join(back, ["node", "to"], "left_anti"), "edge has no way back").distinct())
        .unionByName(said(slots.where("node < 0 AND to < 0"), "anchors are neighbours").distinct())
    )


def distances_to(edges: DataFrame, target: DataFrame, hops: int) -> DataFrame:
    """Distance of every artist within `hops` of the target artists (target, artist_id, dist)."""
    step = edges.select(F.col("artist_b_id").alias("at"), F.col("artist_a_id").alias("to"))
    state = target.select(F.col("artist_id").alias("target"), "artist_id", F.lit(0).alias("dist"))
    for d in range(1, hops + 1):
        last = state.where(F.col("dist") == d - 1).select("target", F.col("artist_id").alias("at"))
        new = last.join(step, "at").select("target", F.col("to").alias("artist_id")).distinct().join(state, ["target", "artist_id"], "left_anti")
        state = state.unionByName(materialize(new.withColumn("dist", F.lit(d)), "distances"))
    return state


def routes(edges: DataFrame, pairs: DataFrame, hops: int, left: DataFrame | None = None, middle: Column | None = None) -> DataFrame:
    """All simple routes of exactly `hops` hops for pairs (start, end), pruned by the distance that is left: start, end, path.

    `left` are known distances (distances_to, at least as far as `hops`); `middle` judges `_to`, an artist on the way."""
    if left is None:
        left = distances_to(edges, pairs.select(F.col("end").alias("artist_id")).distinct(), hops)
    left = left.select(F.col("target").alias("end"), F.col("artist_id").alias("at"), "dist")
    step = edges.select(F.col("artist_a_id").alias("_from"), F.col("artist_b_id").alias("_to"))
    walk = pairs.select("start", "end", F.col("start").alias("_from"), F.array("start").alias("path"))
    for d in range(1, hops + 1):
        walk = walk.join(step, "_from").where(~F.array_contains("path", F.col("_to")))
        walk = walk.where((F.col("_to") == F.col("end")) if d == hops else (F.col("_to") != F.col("end")) & (F.lit(True) if middle is None else middle))
        walk = walk.join(left.where(F.col("dist") <= hops - d).withColumnRenamed("at", "_to"), ["end", "_to"]).drop("dist")
        walk = walk.select("start", "end", F.col("_to").alias("_from"), F.concat("path", F.array("_to")).alias("path"))
    return walk.select("start", "end", "path")


def ranked_routes(edges: DataFrame, pairs: DataFrame, hops: int, k: int = 3, cost: Column | None = None) -> DataFrame:
    """The k best routes of a pair: least busy middle artists (highest degree on the route, then their sum), then the path."""
    found = routes(edges, pairs, hops)
    d = degrees(edges)
    middle = found.withColumn("_m", F.explode(F.slice("path", 2, hops - 1))).join(d, F.col("_m") == F.col("artist_id"))
    facts = middle.groupBy("start", "end", "path").agg(F.max("degree").alias("hub_degree"), F.sum("degree").alias("degree_sum"))
    best = facts.withColumn("rank", F.row_number().over(Window.partitionBy("start", "end").orderBy("hub_degree", "degree_sum", "path"))).where(F.col("rank") <= k)
    return best.select("start", "end", "rank", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"), "hub_degree", "degree_sum")


def explorer_view(edges: DataFrame, seeds: DataFrame, k: int = 24) -> DataFrame:
    """Each seed's k most connected neighbours, with a flag where there are more."""
    d = degrees(edges)
    near = edges.join(F.broadcast(seeds.select(F.col("artist_id").alias("artist_a_id"))), "artist_a_id").select(F.col("artist_a_id").alias("artist_id"), F.col("artist_b_id").alias("neighbor_id"))
    near = near.join(d.select(F.col("artist_id").alias("neighbor_id"), "degree"), "neighbor_id").join(d.select("artist_id", F.col("degree").alias("_all")), "artist_id")
    top = window_rank(near, ["artist_id"], [F.desc("degree"), "neighbor_id"], k)
    return top.select("artist_id", "neighbor_id", "degree", (F.col("_all") > k).alias("truncated"))


def csr_path(graph: dict, start: int, end: int, max_hops: int, max_nodes: int | None = None, without: frozenset[tuple[int, int]] = frozenset()) -> tuple[str, list[int]]:
    """A shortest path in a compact graph held in memory (node_ids, offsets, neighbors), lowest neighbours first: ("found", path),
    ("none", []) if there is proven to be none within the hops, or ("inconclusive", []) if more than max_nodes would have been
    looked at. Edges in `without` (lower id first) are not used."""
    place = {n: i for i, n in enumerate(graph["node_ids"])}
    if start not in place or end not in place:
        return "none", []
    ids, offsets, near = graph["node_ids"], graph["offsets"], graph["neighbors"]
    parent, frontier = {place[start]: None}, [place[start]]
    for _ in range(max_hops + 1):
        if place[end] in parent:
            path, at = [], place[end]
            while at is not None:
                path.append(ids[at])
                at = parent[at]
            return "found", path[::-1]
        after = []
        for u in frontier:
            for v in near[offsets[u] : offsets[u + 1]]:
                if v not in parent and (min(ids[u], ids[v]), max(ids[u], ids[v])) not in without:
                    if max_nodes is not None and len(parent) >= max_nodes:
                        return "inconclusive", []
                    parent[v] = u
                    after.append(v)
        frontier = after
    return "none", []

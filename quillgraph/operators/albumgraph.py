"""Routes between albums: the artists' graph with one virtual anchor node for each album, and the recommended route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.operators import graph
from quillgraph.operators.contributors import joined_texts
from quillgraph.operators.edges import degrees
from quillgraph.operators.enumeration import MAX_EXPANSIONS, MAX_ROUTES, RouteSearch
from quillgraph.plans.lens import Model
from quillgraph.policies import Policy
from quillgraph.sources.scratch import materialize

ANCHOR = "album"  # the role on an anchor's side of an edge


def joined_roles(model: Model, limit: int = 200) -> DataFrame:
    """Per (release, artist) the distinct role texts, those of the whole release before those of its tracks in their order, cut at
    a comma to at most `limit` characters."""
    seen = F.sort_array(F.collect_list(F.struct(F.coalesce("track_index", F.lit(-1)).alias("track"), "credit_scope", "role_text")))
    c = model.credits.where("role_text IS NOT NULL").groupBy("release_id", "artist_id").agg(F.transform(seen, lambda x: x["role_text"]).alias("_r"))
    return c.select("release_id", "artist_id", joined_texts(F.col("_r"), limit).alias("roles"))


def anchors(albums: DataFrame) -> DataFrame:
    """album_id, virtual id (-1, -2, ... in album order) and main release. Albums are a catalog, ordered once."""
    order = Window.orderBy("master_id")
    return albums.select(F.col("master_id").alias("album_id"), (-F.row_number().over(order)).cast("long").alias("anchor_id"), "main_release_id", "artist_id")


def anchored_graph(model: Model, edges: DataFrame, albums: DataFrame, policy: Policy) -> DataFrame:
    """Directed edges (artist_a_id, artist_b_id, release_id, role_a, role_b): those that touch an album's artist, and those
    between each album's anchor and the eligible artists of its main release."""
    a = anchors(albums)
    seeds = F.broadcast(a.select("artist_id").distinct())
    near = edges.join(seeds, F.col("artist_a_id") == F.col("artist_id"), "left_semi").unionByName(edges.join(seeds, F.col("artist_b_id") == F.col("artist_id"), "left_semi")).distinct()
    roles = joined_roles(model)
    for n in "ab":
        near = near.join(roles.select("release_id", F.col("artist_id").alias(f"artist_{n}_id"), F.col("roles").alias(f"role_{n}")), ["release_id", f"artist_{n}_id"], "left")
    credits = model.credits.where(R.is_playable() & R.not_placeholder(F.col("artist_id"), policy) & ~R.edge_ineligible(F.col("role_text"), policy))
    member = credits.join(F.broadcast(a.select(F.col("main_release_id").alias("release_id"), "anchor_id")), "release_id").select("release_id", "anchor_id", "artist_id").distinct()
    member = member.join(roles, ["release_id", "artist_id"], "left")
    out = member.select(F.col("anchor_id").alias("artist_a_id"), F.col("artist_id").alias("artist_b_id"), "release_id", F.lit(ANCHOR).alias("role_a"), F.col("roles").alias("role_b"))
    back = member.select(F.col("artist_id").alias("artist_a_id"), F.col("anchor_id").alias("artist_b_id"), "release_id", F.col("roles").alias("role_a"), F.lit(ANCHOR).alias("role_b"))
    return near.select(*out.columns).unionByName(out).unionByName(back)


def _judged(found: DataFrame, depth: int, edges: DataFrame, degree: DataFrame, severities: DataFrame, policy: Policy) -> DataFrame:
    """Routes of one depth with the worst caveat and the hops without a performer's role between artists, and the highest degree."""
    found = materialize(found.withColumn("depth", F.lit(depth)), "routes")
    keys = ["start", "end", "path"]
    hop = found.select(*keys, F.explode(F.sequence(F.lit(2), F.lit(depth - 1))).alias("i")) if depth > 2 else found.select(*keys, F.lit(0).alias("i")).where("false")
    hop = hop.select(*keys, F.try_element_at("path", F.col("i")).alias("artist_a_id"), F.try_element_at("path", F.col("i") + 1).alias("artist_b_id"))
    facts = hop.join(edges, ["artist_a_id", "artist_b_id"]).withColumn("release_id", F.col("e.release_id")).join(severities, "release_id", "left")
    performs = R.performer_role(F.col("e.role_a"), policy) | R.performer_role(F.col("e.role_b"), policy)
    facts = facts.groupBy(*keys).agg(F.max(F.coalesce("severity", F.lit(0))).alias("severity"), F.count_if(~performs).alias("weak_hops"))
    hubs = found.select(*keys, F.explode("path").alias("artist_id")).where("artist_id > 0").join(degree, "artist_id", "left").groupBy(*keys).agg(F.max(F.coalesce("degree", F.lit(0))).alias("hub_degree"))
    return found.join(facts, keys, "left").join(hubs, keys).select(*keys, "depth", F.coalesce("severity", F.lit(0)).alias("severity"), "hub_degree", F.coalesce("weak_hops", F.lit(0)).alias("weak_hops"))


def _fallback(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """A shortest route (start, end, depth, path) for these pairs, as the reach of both ends finds it, unranked."""
    pairs = materialize(pairs.select(F.least("start", "end").alias("seed_a"), F.greatest("start", "end").alias("seed_b"), "start", "end"), "fallback-pairs")
    seeds = pairs.select(F.col("seed_a").alias("artist_id")).unionByName(pairs.select(F.col("seed_b").alias("artist_id"))).distinct()
    out = edges.where("artist_b_id > 0").select("artist_a_id", "artist_b_id", F.col("e.release_id").alias("release_id"))  # anchors are left, never entered
    scored, reached = graph.scored_pairs(out, seeds, depth, pairs=pairs.select("seed_a", "seed_b").distinct())
    paths = graph.pair_paths(reached, scored).groupBy("seed_a", "seed_b").agg(F.sort_array(F.collect_list(F.struct("hop", "to_id"))).alias("_h"))
    paths = paths.select("seed_a", "seed_b", F.size("_h").alias("depth"), F.concat(F.array("seed_a"), F.transform("_h", lambda h: h["to_id"])).alias("_p"))
    return pairs.join(paths, ["seed_a", "seed_b"]).select("start", "end", "depth", F.when(F.col("start") == F.col("seed_a"), F.col("_p")).otherwise(F.reverse("_p")).alias("path"))


def recommended_routes(
    graph_edges: DataFrame, pairs: DataFrame, severities: DataFrame, policy: Policy, max_hops: int = 4, allowed: Column | None = None, excluded: DataFrame | None = None,
    max_routes: int = MAX_ROUTES, max_expansions: int = MAX_EXPANSIONS,
) -> DataFrame:
    """For pairs (start, end) of anchors the best route: start, end, hops between artists, path, severity, hub_degree, weak_hops,
    longer, degraded.

    All routes of the shortest length are ranked: worst evidence caveat, highest degree on the way, hops without a
    performer's role, then the path. Routes of one hop more take over only where they avoid a caveat that every shortest one
    has. Routes are enumerated layer by layer, for pairs that are not done only, within the budgets of RouteSearch. Where a budget
    cut a layer that the choice rests on, the route is degraded: real, but not known to be the best; pairs whose shortest layer
    could not be enumerated at all get one shortest route, unranked. `allowed` filters edges by role_a and role_b, and anchor edges
    always pass; `excluded` edges (artist_a_id, artist_b_id) are not used in either direction. The route of (end, start) is the
    same one reversed, up to ties.
    """
    if allowed is not None:
        graph_edges = graph_edges.where((F.col("artist_a_id") < 0) | (F.col("artist_b_id") < 0) | allowed)
    if excluded is not None:
        graph_edges = graph.without_edges(graph_edges, excluded)
    graph_edges = materialize(graph_edges, "anchored")
    edges = materialize(graph_edges.groupBy("artist_a_id", "artist_b_id").agg(F.min(F.struct("release_id", "role_a", "role_b")).alias("e")), "anchored-edges")
    inner = edges.where("artist_a_id > 0 AND artist_b_id > 0")
    degree = degrees(inner)
    severities = materialize(severities.select("release_id", "severity"), "severities")
    search, ranked = RouteSearch(edges, pairs, max_hops + 2, max_routes, max_expansions, F.col("_to") > 0), None
    for depth in range(2, max_hops + 3):
        found = search.layer(depth)
        layer = materialize(_judged(found.select("start", "end", "path"), depth, edges, degree, severities, policy), "layer")
        ranked = layer if ranked is None else ranked.unionByName(layer)
        # a pair is done one hop after its shortest routes, or at once if one of them has no caveat
        done = ranked.groupBy("start", "end").agg(F.min("depth").alias("least"), F.min(F.when(F.col("severity") == 0, 0).otherwise(1)).alias("worst"))
        search.close(done.where((F.col("worst") == 0) | (F.col("least") < depth)))
    state = materialize(search.pairs(), "route-pairs")
    ranked = ranked.join(ranked.groupBy("start", "end").agg(F.min("depth").alias("least")), ["start", "end"])
    # a longer route is worth considering only below the best severity of the shortest ones
    best = ranked.where("depth = least").groupBy("start", "end").agg(F.min("severity").alias("best"))
    fit = ranked.join(best, ["start", "end"]).where("depth = least OR severity < best")
    order = Window.partitionBy("start", "end").orderBy("severity", "hub_degree", "weak_hops", "depth", "path")
    top = fit.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").join(state.select("start", "end", "stopped"), ["start", "end"])
    top = top.select("start", "end", "depth", "path", "severity", "hub_degree", "weak_hops", (F.col("depth") > F.col("least")).alias("longer"), F.col("stopped").isNotNull().alias("degraded"))
    lost = state.where("stopped = 'expansions' AND routes = 0")
    if lost.limit(1).count():
        plain = _fallback(edges, lost, max_hops + 2)
        top = top.unionByName(plain.select("start", "end", "depth", "path", F.lit(None).cast("int").alias("severity"), F.lit(0).cast("long").alias("hub_degree"), F.lit(0).cast("long").alias("weak_hops"), F.lit(False).alias("longer"), F.lit(True).alias("degraded")))
    return top.select("start", "end", (F.col("depth") - 2).alias("hops"), F.array_join(F.transform("path", lambda x: x.cast("string")), "|").alias("path"), "severity", "hub_degree", "weak_hops", "longer", "degraded")


def explained_routes(routes: DataFrame) -> DataFrame:
    """recommended_routes with the reason for the choice in words."""
    hops = F.concat(F.col("hops").cast("string"), F.when(F.col("hops") == 1, " hop").otherwise(" hops"))
    caveat = F.when(F.col("severity").isNull(), "evidence not judged").when(F.col("severity") == 0, "no caveat on its evidence").otherwise(F.concat(F.lit("worst caveat tier "), F.col("severity").cast("string")))
    hub = F.when(F.col("hub_degree") > 0, F.concat(F.lit("busiest artist with "), F.col("hub_degree").cast("string"), F.lit(" neighbours")))
    weak = F.when(F.col("weak_hops") > 0, F.concat(F.col("weak_hops").cast("string"), F.lit(" without a performer's role")))
    kind = F.when(F.col("degraded"), "shortest found, not ranked in full").when(F.col("longer"), "one hop longer, to avoid a caveat").otherwise("best of the shortest")
    return routes.withColumn("explanation", F.concat_ws("; ", kind, hops, caveat, hub, weak))

"""All simple routes between many pairs at once, by iterative deepening within budgets of routes and of expansions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.operators.edges import degrees
from quillgraph.plans.lens import Model
from quillgraph.policies import Policy
from quillgraph.sources.scratch import materialize

#: Routes kept for a pair beyond its shortest ones, and neighbours looked at for a pair, at most.
MAX_ROUTES, MAX_EXPANSIONS = 200, 200_000

_PAIR = ["start", "end"]


@dataclass(frozen=True)
class Enumeration:
    """routes: start, end, hops, path. pairs: start, end, shortest (null: none within the hops), routes, equal_routes (those of the
    shortest length), expansions, stopped (null, `routes` or `expansions`), stopped_at (hops)."""

    routes: DataFrame
    pairs: DataFrame


class RouteSearch:
    """Routes of growing length for pairs (start, end) of artists, a layer of equal length at a time.

    The state of a pair is a row: what it has spent, how many routes it holds, and whether and where a budget stopped it. A pair's
    cost is known before it is paid: the degrees of the artists it stands at are summed first, and a pair whose sum would exceed
    its expansions is stopped there, so that no join grows beyond the budgets. Distances to the end, by which walks are pruned,
    are charged too. A layer is held whole or not at all if expansions run out; if a pair would hold more than max_routes, it keeps
    the first of them in order of the path and stops. The shortest layer is never cut by max_routes. `middle` judges `_to`, an
    artist on the way.
    """

    def __init__(self, edges: DataFrame, pairs: DataFrame, max_hops: int, max_routes: int = MAX_ROUTES, max_expansions: int = MAX_EXPANSIONS, middle: Column | None = None):
        self.max_hops, self.max_routes, self.max_expansions = max_hops, max_routes, max_expansions
        self.middle = F.lit(True) if middle is None else middle
        self.step = edges.select(F.col("artist_a_id").alias("_from"), F.col("artist_b_id").alias("_to")).distinct()
        self.degree = materialize(degrees(self.step.withColumnRenamed("_from", "artist_a_id")).select(F.col("artist_id").alias("_from"), "degree"), "route-degrees")
        pairs = materialize(pairs.select(*_PAIR).where("start <> end").distinct(), "route-pairs")
        self.left, ends = self._distances(pairs.select("end").distinct())
        near = self.left.select("end", F.col("at").alias("start"), F.col("dist").alias("shortest"))
        state = pairs.join(ends, "end").join(near, _PAIR, "left").select(
            *_PAIR, F.when(~F.col("over"), F.col("shortest")).alias("shortest"), F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("equal"), "spent",
            F.when(F.col("over"), "expansions").alias("stopped"), F.when(F.col("over"), 0).alias("stopped_at"), F.lit(False).alias("closed"),
        )
        self.state = materialize(state, "route-state")

    def _distances(self, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(end, at, dist) within max_hops, and (end, spent, over): ends whose next level would exceed the budget are over."""
        known = ends.select("end", F.lit(0).cast("long").alias("spent"), F.lit(False).alias("over"))
        state = ends.select("end", F.col("end").alias("at"), F.lit(0).alias("dist"))
        last = state
        for d in range(1, self.max_hops + 1):
            walkers = last if d == 1 else last.withColumn("_to", F.col("at")).where(self.middle).drop("_to")
            cost = walkers.join(self.degree, F.col("at") == F.col("_from")).groupBy("end").agg(F.sum("degree").alias("cost"))
            known = known.join(cost, "end", "left").withColumn("cost", F.coalesce("cost", F.lit(0)))
            over = F.col("over") | (F.col("spent") + F.col("cost") > self.max_expansions)
            known = materialize(known.select("end", F.when(over, F.col("spent")).otherwise(F.col("spent") + F.col("cost")).alias("spent"), over.alias("over")), "route-ends")
            walkers = walkers.join(known.where("NOT over").select("end"), "end", "left_semi")
            new = walkers.join(self.step.select(F.col("_to").alias("at"), F.col("_from").alias("_next")), "at").select("end", F.col("_next").alias("at")).distinct()
            last = materialize(new.join(state, ["end", "at"], "left_anti").withColumn("dist", F.lit(d)), "route-distances")
            state = state.unionByName(last)
        return state, known

    def close(self, pairs: DataFrame) -> None:
        """No longer routes are wanted for these pairs."""
        done = pairs.select(*_PAIR, F.lit(True).alias("_done")).distinct()
        self.state = materialize(self.state.join(done, _PAIR, "left").withColumn("closed", F.col("closed") | F.coalesce("_done", F.lit(False))).drop("_done"), "route-state")

    def layer(self, hops: int) -> DataFrame:
        """Routes (start, end, path) of exactly this many hops of the pairs that are still open."""
        active = self.state.where(F.col("stopped").isNull() & ~F.col("closed") & (F.col("shortest") <= hops))
        walk = active.select(*_PAIR, F.col("start").alias("_from"), F.array("start").alias("path"), "spent")
        walk = materialize(walk, "route-walk")
        spent = walk.select(*_PAIR, "spent", F.lit(False).alias("over"))
        left = self.left.withColumnRenamed("at", "_to")
        for d in range(1, hops + 1):
            cost = walk.join(self.degree, "_from").groupBy(*_PAIR).agg(F.sum("degree").alias("cost"))
            spent = spent.join(cost, _PAIR, "left").withColumn("cost", F.coalesce("cost", F.lit(0)))
            over = F.col("over") | (F.col("spent") + F.col("cost") > self.max_expansions)
            spent = materialize(spent.select(*_PAIR, F.when(over, F.col("spent")).otherwise(F.col("spent") + F.col("cost")).alias("spent"), over.alias("over")), "route-spent")
            walk = walk.join(spent.where("NOT over").select(*_PAIR), _PAIR, "left_semi").join(self.step, "_from").where(~F.array_contains("path", F.col("_to")))
            walk = walk.where((F.col("_to") == F.col("end")) if d == hops else (F.col("_to") != F.col("end")) & self.middle)
            walk = walk.join(left.where(F.col("dist") <= hops - d), ["end", "_to"]).select(*_PAIR, F.col("_to").alias("_from"), F.concat("path", F.array("_to")).alias("path"))
            walk = materialize(walk, "route-walk")
        found = walk.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("new"))
        after = self.state.join(spent.select(*_PAIR, F.col("spent").alias("_spent"), "over"), _PAIR, "left").join(found, _PAIR, "left")
        whole = F.coalesce("new", F.lit(0))
        room = F.when(F.col("shortest") == hops, whole).otherwise(F.greatest(self.max_routes - F.col("held"), F.lit(0)))
        full = whole > room
        after = after.select(
            *_PAIR, "shortest", (F.col("held") + F.least(whole, room)).alias("held"), F.when(F.col("shortest") == hops, whole).otherwise(F.col("equal")).alias("equal"), F.coalesce("_spent", "spent").alias("spent"),
            F.coalesce("stopped", F.when(F.col("over"), "expansions"), F.when(full, "routes")).alias("stopped"), F.coalesce("stopped_at", F.when(F.col("over") | full, hops)).alias("stopped_at"), "closed", room.alias("_room"),
        )
        after = materialize(after, "route-state")
        self.state = after.drop("_room")
        order = Window.partitionBy(*_PAIR).orderBy("path")
        kept = walk.select(*_PAIR, "path").join(after.select(*_PAIR, "_room"), _PAIR).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= F.col("_room"))
        return materialize(kept.select(*_PAIR, F.lit(hops).alias("hops"), "path"), "route-layer")

    def pairs(self) -> DataFrame:
        return self.state.select(*_PAIR, "shortest", F.col("held").alias("routes"), F.col("equal").alias("equal_routes"), F.col("spent").alias("expansions"), "stopped", "stopped_at")


def enumerate_routes(edges: DataFrame, pairs: DataFrame, max_hops: int, max_routes: int = MAX_ROUTES, max_expansions: int = MAX_EXPANSIONS, middle: Column | None = None) -> Enumeration:
    """Every simple route of at most max_hops for pairs (start, end), shortest first, within the budgets of RouteSearch."""
    search, routes = RouteSearch(edges, pairs, max_hops, max_routes, max_expansions, middle), None
    for hops in range(1, max_hops + 1):
        layer = search.layer(hops)
        routes = layer if routes is None else routes.unionByName(layer)
    return Enumeration(routes, search.pairs())


def route_facts(routes: DataFrame, edges: DataFrame, model: Model, policy: Policy) -> DataFrame:
    """Per route: its artists on the way counted by degree (highest and mean), the releases that are its evidence, the role
    categories on them, and the share of hops with a performer's role."""
    key = [*_PAIR, "path"]
    d = degrees(edges)
    inner = routes.select(*key, F.explode(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0)))).alias("artist_id")).join(d, "artist_id")
    inner = inner.groupBy(*key).agg(F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"))
    at = F.explode(F.sequence(F.lit(1), F.size("path") - 1))
    hop = routes.select(*key, at.alias("_i")).select(*key, "_i", F.element_at("path", F.col("_i")).alias("artist_a_id"), F.element_at("path", F.col("_i") + 1).alias("artist_b_id")).join(edges, ["artist_a_id", "artist_b_id"])
    hop = materialize(hop, "route-hops")
    either = hop.select("release_id", F.col("artist_a_id").alias("artist_id")).unionByName(hop.select("release_id", F.col("artist_b_id").alias("artist_id"))).distinct()
    said = model.credits.join(either, ["release_id", "artist_id"], "left_semi").select("release_id", "artist_id", "role_text").distinct()
    said = said.withColumn("categories", R.role_categories(F.col("role_text"), policy)).withColumn("performs", F.coalesce(R.performer_role(F.col("role_text"), policy), F.lit(False)))
    of = materialize(said.groupBy("release_id", "artist_id").agg(F.array_distinct(F.flatten(F.collect_set("categories"))).alias("categories"), F.max("performs").alias("performs")), "route-roles")
    for n in "ab":
        hop = hop.join(of.select("release_id", F.col("artist_id").alias(f"artist_{n}_id"), F.col("categories").alias(f"categories_{n}"), F.col("performs").alias(f"performs_{n}")), ["release_id", f"artist_{n}_id"], "left")
    performs = F.coalesce("performs_a", F.lit(False)) | F.coalesce("performs_b", F.lit(False))
    none = F.array().cast("array<string>")
    facts = hop.groupBy(*key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "release_id"))), lambda x: x["release_id"]).alias("release_ids"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("categories_a", none), F.coalesce("categories_b", none)))))).alias("categories"),
        F.avg(performs.cast("double")).alias("performer_share"),
    )
    return routes.join(facts, key).join(inner, key, "left").select(*routes.columns, F.coalesce("max_degree", F.lit(0)).alias("max_degree"), F.coalesce("mean_degree", F.lit(0.0)).alias("mean_degree"), "release_ids", "categories", "performer_share")

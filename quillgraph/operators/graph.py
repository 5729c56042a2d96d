"""Graph questions over the edge relation: neighbours, bounded paths, multi-seed reach, pair status, evidence."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.operators.components import components
from quillgraph.operators.edges import degrees
from quillgraph.plans.lens import Model
from quillgraph.policies import Policy
from quillgraph.sources.scratch import materialize


class FrontierTooLarge(RuntimeError):
    """A bounded search ended without having looked everywhere: neither a path nor its absence is proven."""


def ids_frame(spark: SparkSession, ids: Iterable[int], name: str = "artist_id") -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], f"{name} long")


def neighbors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each seed with its neighbours and evidence, and a row without a neighbour for seeds that have none."""
    e = edges.select(F.col("artist_a_id").alias("artist_id"), F.col("artist_b_id").alias("neighbor_id"), "release_id")
    return seeds.join(e, "artist_id", "left")


@dataclass(frozen=True)
class Reach:
    """What seeds have reached (seed_id, artist_id, parent_id, release_id, dist), and the seeds that reached too much (seed_id):
    these have no rows."""

    rows: DataFrame
    failed: DataFrame


def bounded_reach(edges: DataFrame, seeds: DataFrame, hops: int, max_degree: int | None = None, max_rows: int | None = None) -> Reach:
    """Breadth-first reach of all seeds at once; a reached artist keeps the (release, parent) lowest in order at its distance.

    Artists of a degree above max_degree are reached but not expanded; seeds always are. A seed with more than max_rows rows after
    a hop fails: its rows are dropped and it is not expanded further, so that no pair is judged by half a reach. Each hop is one
    join of the last level with the edges; levels are written to the shared folder, so that plans stay short.
    """
    step = edges.select(F.col("artist_a_id").alias("parent_id"), F.col("artist_b_id").alias("to"), "release_id")
    if max_degree is not None:
        step = step.join(degrees(edges).where(F.col("degree") <= max_degree).select(F.col("artist_id").alias("parent_id"), F.lit(True).alias("_open")), "parent_id", "left")
    else:
        step = step.withColumn("_open", F.lit(True))
    none = F.lit(None).cast("long")
    state = seeds.select(F.col("artist_id").alias("seed_id"), "artist_id", none.alias("parent_id"), none.alias("release_id"), F.lit(0).alias("dist"))
    last = state
    failed = edges.sparkSession.createDataFrame([], "seed_id long")
    for d in range(1, hops + 1):
        found = last.select("seed_id", F.col("artist_id").alias("parent_id")).join(step if d == 1 else step.where("_open"), "parent_id")
        best = found.groupBy("seed_id", F.col("to").alias("artist_id")).agg(F.min(F.struct("release_id", "parent_id")).alias("_b"))
        new = best.join(state.select("seed_id", "artist_id"), ["seed_id", "artist_id"], "left_anti")
        last = materialize(new.select("seed_id", "artist_id", F.col("_b.parent_id").alias("parent_id"), F.col("_b.release_id").alias("release_id"), F.lit(d).alias("dist")), "reach")
        state = state.unionByName(last)
        if max_rows is not None:
            over = materialize(state.groupBy("seed_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows).select("seed_id"), "reach-over")
            failed = failed.unionByName(over)
            state, last = (x.join(over, "seed_id", "left_anti") for x in (state, last))
    return Reach(state, failed)


def reach(edges: DataFrame, seeds: DataFrame, hops: int, max_degree: int | None = None) -> DataFrame:
    """The rows of bounded_reach without a bound on rows."""
    return bounded_reach(edges, seeds, hops, max_degree).rows


def _meeting(open_: DataFrame, reached: DataFrame, da: int, db: int) -> DataFrame:
    """Artists at distance da from seed_a and db from seed_b, for open pairs. The nearer side is listed, the farther one looked up,
    so no artist brings all its seeds together."""
    near, far = (("seed_a", da), ("seed_b", db)) if da <= db else (("seed_b", db), ("seed_a", da))
    listed, known = (reached.where(F.col("dist") == d).select(F.col("seed_id").alias(name), F.col("artist_id").alias("via")) for name, d in (near, far))
    return open_.join(listed, near[0]).join(known, [far[0], "via"], "left_semi").select("seed_a", "seed_b", "via")


def meet(reached: DataFrame, pairs: DataFrame, max_hops: int, half: int) -> DataFrame:
    """Pairs (seed_a, seed_b) that meet within max_hops, each seed having been expanded to half hops: seed_a, seed_b, hops, via (the
    lowest artist in the middle of a shortest way). Distance by distance; pairs that have met are taken out first."""
    reached = materialize(reached.select("seed_id", "artist_id", "dist"), "reached")
    open_, found = materialize(pairs.select("seed_a", "seed_b").distinct(), "pairs"), None
    for hops in range(min(max_hops, 2 * half) + 1):
        ways = [_meeting(open_, reached, da, hops - da) for da in range(max(0, hops - half), min(hops, half) + 1)]
        here = functools.reduce(DataFrame.unionByName, ways).groupBy("seed_a", "seed_b").agg(F.min("via").alias("via"))
        here = materialize(here.select("seed_a", "seed_b", F.lit(hops).alias("hops"), "via"), "met")
        found = here if found is None else found.unionByName(here)
        open_ = materialize(open_.join(here, ["seed_a", "seed_b"], "left_anti"), "pairs")
    return found


def seed_pairs(seeds: DataFrame) -> DataFrame:
    """All pairs of seeds, the lower one first."""
    a, b = (seeds.select(F.col("artist_id").alias(f"seed_{n}")) for n in "ab")
    return a.join(b, F.col("seed_a") < F.col("seed_b"))


def pair_distances(reached: DataFrame, max_hops: int, half: int | None = None) -> DataFrame:
    """Shortest distance of each pair of seeds through a common reached artist, with the lowest such artist."""
    half = -(-max_hops // 2) if half is None else half
    return meet(reached, seed_pairs(reached.where("dist = 0").select("artist_id")), max_hops, half)


def scored_pairs(edges: DataFrame, seeds: DataFrame, max_hops: int = 3, max_degree: int | None = None, max_rows: int | None = None, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Each pair of seeds (or of `pairs`: seed_a, seed_b) with status, hops, via and skip_reason, and the reach behind it.

    found; no_path, only where both ends were expanded completely; else skipped: reach_too_large where a seed reached more than
    max_rows, frontier_too_large where an artist of a degree above max_degree was left unexpanded on either side.
    """
    half = -(-max_hops // 2)
    got = bounded_reach(edges, seeds, half, max_degree, max_rows)
    reached = materialize(got.rows, "reach-all")
    pairs = seed_pairs(seeds) if pairs is None else pairs
    failed = got.failed.select(F.col("seed_id").alias("artist_id"), F.lit(True).alias("large"))
    known = seeds.select("artist_id").distinct().join(failed, "artist_id", "left")
    if max_degree is None:
        known = known.withColumn("cut", F.lit(False))
    else:
        hubs = degrees(edges).where(F.col("degree") > max_degree).select("artist_id")
        hit = reached.where((F.col("dist") > 0) & (F.col("dist") < half)).join(hubs, "artist_id", "left_semi").select(F.col("seed_id").alias("artist_id"), F.lit(True).alias("cut")).distinct()
        known = known.join(hit, "artist_id", "left")
    known = materialize(known.select("artist_id", F.coalesce("large", F.lit(False)).alias("large"), F.coalesce("cut", F.lit(False)).alias("cut")), "seeds-known")
    a, b = (known.select(F.col("artist_id").alias(f"seed_{n}"), F.col("large").alias(f"large_{n}"), F.col("cut").alias(f"cut_{n}")) for n in "ab")
    judged = pairs.join(a, "seed_a").join(b, "seed_b").join(meet(reached, pairs, max_hops, half), ["seed_a", "seed_b"], "left")
    reason = F.when(F.col("hops").isNotNull(), None).when(F.col("large_a") | F.col("large_b"), "reach_too_large").when(F.col("cut_a") | F.col("cut_b"), "frontier_too_large")
    status = F.when(F.col("hops").isNotNull(), "found").when(reason.isNotNull(), "skipped").otherwise("no_path")
    return judged.select("seed_a", "seed_b", status.alias("status"), "hops", "via", reason.alias("skip_reason")), reached


def pair_status(edges: DataFrame, seeds: DataFrame, max_hops: int = 3, max_degree: int | None = None) -> DataFrame:
    """found / no_path / skipped for each pair of seeds; skipped where a capped artist was met on either side, so that
    absence is not proven."""
    return scored_pairs(edges, seeds, max_hops, max_degree)[0].drop("skip_reason")


def pair_paths(reached: DataFrame, met: DataFrame) -> DataFrame:
    """The hops of all met pairs (seed_a, seed_b, hops, via) at once: seed_a, seed_b, hop (from 1), from_id, to_id, release_id.

    Both halves are followed back from the artist in the middle, parent by parent: one join of all open ends with the reach for each
    hop, no search and nothing on the driver.
    """
    back = reached.where("dist > 0").select(F.col("seed_id").alias("_seed"), F.col("artist_id").alias("_at"), "parent_id", "release_id", "dist")
    ends = met.where("hops IS NOT NULL").select("seed_a", "seed_b", "hops", "via")
    open_ = ends.select("*", F.lit(True).alias("_ahead"), F.col("seed_a").alias("_seed")).unionByName(ends.select("*", F.lit(False).alias("_ahead"), F.col("seed_b").alias("_seed"))).withColumnRenamed("via", "_at")
    out = None
    while True:
        at = materialize(open_.join(back, ["_seed", "_at"]), "paths")
        hop = F.when(F.col("_ahead"), F.col("dist")).otherwise(F.col("hops") - F.col("dist") + 1)
        rows = at.select("seed_a", "seed_b", hop.cast("int").alias("hop"), F.when(F.col("_ahead"), F.col("parent_id")).otherwise(F.col("_at")).alias("from_id"), F.when(F.col("_ahead"), F.col("_at")).otherwise(F.col("parent_id")).alias("to_id"), "release_id")
        out = rows if out is None else out.unionByName(rows)
        open_ = at.where("dist > 1").select("seed_a", "seed_b", "hops", "_ahead", "_seed", F.col("parent_id").alias("_at"))
        if not open_.limit(1).count():
            return out


def reversed_paths(paths: DataFrame) -> DataFrame:
    """Paths walked from the other end: hops numbered from there, each with its ends exchanged."""
    last = F.max("hop").over(Window.partitionBy("seed_a", "seed_b"))
    return paths.select(F.col("seed_b").alias("seed_a"), F.col("seed_a").alias("seed_b"), (last - F.col("hop") + 1).alias("hop"), F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "release_id")


def without_edges(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """Edges but for the excluded ones (artist_a_id, artist_b_id), in either direction."""
    x = excluded.select("artist_a_id", "artist_b_id")
    x = x.unionByName(x.select(F.col("artist_b_id").alias("artist_a_id"), F.col("artist_a_id").alias("artist_b_id"))).distinct()
    return edges.join(x, ["artist_a_id", "artist_b_id"], "left_anti")


def find_path(edges: DataFrame, start: int, end: int, max_hops: int = 4, max_frontier_degree: int | None = None) -> list[dict] | None:
    """The shortest path as hops with evidence; at each level an artist is entered from its lowest parent. None if there is
    proven to be none; FrontierTooLarge if an unexpanded artist leaves that open.

    The driver holds the levels of one search; each level is one join of the frontier with the edges.
    """
    spark = edges.sparkSession
    if start == end:
        return []
    parents: dict[int, tuple[int, int]] = {start: (0, 0)}
    frontier, cut = [start], False
    degree = degrees(edges)
    for _ in range(max_hops):
        if max_frontier_degree is not None:
            wide = {r["artist_id"] for r in degree.join(F.broadcast(ids_frame(spark, frontier)), "artist_id").where(F.col("degree") > max_frontier_degree).collect()}
            cut |= bool(wide)
            frontier = [i for i in frontier if i not in wide]
        if not frontier:
            break
        at = ids_frame(spark, frontier, "artist_a_id")
        rows = edges.join(F.broadcast(at), "artist_a_id").groupBy("artist_b_id").agg(F.min(F.struct("artist_a_id", "release_id")).alias("_p")).collect()
        new = {r["artist_b_id"]: (r["_p"]["artist_a_id"], r["_p"]["release_id"]) for r in rows if r["artist_b_id"] not in parents}
        parents |= new
        if end in new:
            hops, at_id = [], end
            while at_id != start:
                p, release = parents[at_id]
                hops.append({"from": p, "to": at_id, "release_id": release})
                at_id = p
            return hops[::-1]
        frontier = sorted(new)
    if cut:
        raise FrontierTooLarge(f"{start} to {end}: some artists were too connected to be expanded")
    return None


def credit_rows(model: Model, wanted: DataFrame, policy: Policy, eligible_only: bool = False) -> DataFrame:
    """All credits of the wanted (release_id, artist_id) rows, or only those that can make an edge."""
    c = model.credits if not eligible_only else model.credits.where(~R.edge_ineligible(F.col("role_text"), policy))
    return c.join(wanted.select("release_id", "artist_id").distinct(), ["release_id", "artist_id"], "left_semi")


def missing_evidence(claimed: DataFrame, credits: DataFrame) -> DataFrame:
    """Claimed credit rows that do not occur verbatim (null role texts are equal)."""
    keys = ["release_id", "artist_id", "credit_scope", "role_text", "track_index"]
    a, b = claimed.alias("a"), credits.select(*keys).distinct().alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, "left_anti")


def hop_quality(model: Model, edges: DataFrame, policy: Policy) -> DataFrame:
    """How good the evidence of each undirected edge is.

    strength: co_billed_release_artists (both billed), performer_credit (one billed, or with a role that is not only of the
    grading list), else non_performer_only. scope: same_recording (a track in common, or one billed and the other on a track),
    else release_scope_credit. placeholder: whether either end is a known placeholder.
    """
    e = edges.where("artist_a_id < artist_b_id")
    c = model.credits.where("artist_id IS NOT NULL").groupBy("release_id", "artist_id").agg(
        F.max(F.col("credit_scope") == "release_artist").alias("billed"),
        F.max(~R.only_graded_roles(F.col("role_text"), policy)).alias("performs"),
        F.collect_set("track_index").alias("tracks"),
    )
    a, b = (c.select("release_id", F.col("artist_id").alias(f"artist_{n}_id"), F.col("billed").alias(f"billed_{n}"), F.col("performs").alias(f"performs_{n}"), F.col("tracks").alias(f"tracks_{n}")) for n in "ab")
    j = e.join(a, ["release_id", "artist_a_id"]).join(b, ["release_id", "artist_b_id"])
    either = F.col("billed_a") | F.col("billed_b") | F.col("performs_a") | F.col("performs_b")
    strength = F.when(F.col("billed_a") & F.col("billed_b"), "co_billed_release_artists").when(either, "performer_credit").otherwise("non_performer_only")
    on_track = lambda n: F.size(f"tracks_{n}") > 0
    same = F.coalesce(F.arrays_overlap("tracks_a", "tracks_b"), F.lit(False)) | (F.col("billed_a") & on_track("b")) | (F.col("billed_b") & on_track("a"))
    known = [*policy.placeholder_ids, *policy.flagged_ids]
    odd = (F.col("artist_a_id").isin(known) | F.col("artist_b_id").isin(known)) if known else F.lit(False)
    return j.select("artist_a_id", "artist_b_id", "release_id", strength.alias("strength"), F.when(same, "same_recording").otherwise("release_scope_credit").alias("scope"), odd.alias("placeholder"))


def ego_network(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Undirected edges that touch a seed."""
    e = edges.where("artist_a_id < artist_b_id")
    s = F.broadcast(seeds.select("artist_id"))
    touched = e.join(s, F.col("artist_a_id") == F.col("artist_id"), "left_semi").unionByName(e.join(s, F.col("artist_b_id") == F.col("artist_id"), "left_semi"))
    return touched.distinct()


def label_components(edges: DataFrame) -> DataFrame:
    """Connected components (artist_id, component: its lowest artist) of all artists with an edge."""
    nodes = edges.select(F.col("artist_a_id").alias("artist_id")).distinct()
    roots = components(edges.select(F.col("artist_a_id").alias("a"), F.col("artist_b_id").alias("b")), "artists").select(F.col("node").alias("artist_id"), F.col("root").alias("component"))
    return nodes.join(roots, "artist_id", "left").select("artist_id", F.coalesce("component", "artist_id").alias("component"))

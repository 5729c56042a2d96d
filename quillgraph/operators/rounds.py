"""Questions over albums: shared contributors, unique middles, distractors, and candidate routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.operators.edges import window_rank
from quillgraph.plans.lens import Model
from quillgraph.policies import Policy


def album_performers(model: Model, albums: DataFrame, policy: Policy, role: Column | None = None) -> DataFrame:
    """(album_id, artist_id) of the artists with an eligible role on an album's main release."""
    c = model.credits.where(R.is_playable() & R.not_placeholder(F.col("artist_id"), policy)).where(R.performer_role(F.col("role_text"), policy) if role is None else role)
    return c.join(F.broadcast(albums.select(F.col("main_release_id").alias("release_id"), F.col("master_id").alias("album_id"))), "release_id").select("album_id", "artist_id").distinct()


def shared_performers(performers: DataFrame) -> DataFrame:
    """Pairs of albums with the artists they share: count and lowest id."""
    x, y = (performers.select("artist_id", F.col("album_id").alias(f"album_{n}")) for n in "ab")
    return x.join(y, "artist_id").where("album_a < album_b").groupBy("album_a", "album_b").agg(F.count(F.lit(1)).alias("shared"), F.min("artist_id").alias("artist_id"))


def unique_middles(pairs: DataFrame) -> DataFrame:
    """Pairs of albums without a shared artist that exactly one third album joins."""
    both = pairs.select(F.col("album_a").alias("a"), F.col("album_b").alias("m")).unionByName(pairs.select(F.col("album_b").alias("a"), F.col("album_a").alias("m")))
    two = both.join(both.select(F.col("a").alias("c"), "m"), "m").where("a < c")
    counted = two.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("middle")).where("n = 1")
    return counted.join(pairs.select(F.col("album_a").alias("a"), F.col("album_b").alias("c")), ["a", "c"], "left_anti").select(F.col("a").alias("album_a"), F.col("c").alias("album_c"), "middle")


def distractors(performers: DataFrame, pairs: DataFrame, k: int = 4) -> DataFrame:
    """For each pair up to k artists of either album who are not on both, lowest ids first."""
    either = pairs.select("album_a", "album_b", F.explode(F.array("album_a", "album_b")).alias("album_id")).join(performers, "album_id")
    once = either.groupBy("album_a", "album_b", "artist_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return window_rank(once.drop("n"), ["album_a", "album_b"], ["artist_id"], k)


def role_mode_counts(model: Model, albums: DataFrame, policy: Policy, modes: dict[str, Column]) -> DataFrame:
    """For each role predicate: albums with an eligible artist, pairs that share one, and pairs that one album bridges."""
    out = None
    for name, role in modes.items():
        p = album_performers(model, albums, policy, role)
        pairs = shared_performers(p)
        bridged = unique_or_more(pairs)
        row = p.agg(F.countDistinct("album_id").alias("albums")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("one_hop"))).crossJoin(bridged.agg(F.count(F.lit(1)).alias("two_hop"))).select(F.lit(name).alias("mode"), "albums", "one_hop", "two_hop")
        out = row if out is None else out.unionByName(row)
    return out


def unique_or_more(pairs: DataFrame) -> DataFrame:
    """Pairs of albums without a shared artist that at least one third album joins."""
    both = pairs.select(F.col("album_a").alias("a"), F.col("album_b").alias("m")).unionByName(pairs.select(F.col("album_b").alias("a"), F.col("album_a").alias("m")))
    two = both.join(both.select(F.col("a").alias("c"), "m"), "m").where("a < c").select("a", "c").distinct()
    return two.join(pairs.select(F.col("album_a").alias("a"), F.col("album_b").alias("c")), ["a", "c"], "left_anti")


def route_candidates(edges: DataFrame, model: Model, albums: DataFrame, policy: Policy) -> DataFrame:
    """Two-hop routes between albums' billed artists over one bridge artist: number of bridges and the lowest one."""
    ends = albums.select("master_id", "artist_id")
    e = edges.select("artist_a_id", "artist_b_id")
    near = e.join(F.broadcast(ends.select(F.col("artist_id").alias("artist_a_id"), F.col("master_id").alias("album"))), "artist_a_id").select("album", F.col("artist_a_id").alias("end"), F.col("artist_b_id").alias("bridge"))
    x, y = (near.select("bridge", F.col("album").alias(f"album_{n}"), F.col("end").alias(f"end_{n}")) for n in "ab")
    met = x.join(y, "bridge").where("album_a < album_b AND end_a <> end_b AND bridge <> end_a AND bridge <> end_b")
    return met.groupBy("album_a", "album_b").agg(F.count(F.lit(1)).alias("bridges"), F.min("bridge").alias("bridge"))


def album_membership(model: Model, albums: DataFrame, policy: Policy) -> DataFrame:
    """Each album's eligible artists as one ordered list."""
    p = model.credits.where(R.is_playable() & R.not_placeholder(F.col("artist_id"), policy) & ~R.edge_ineligible(F.col("role_text"), policy))
    p = p.join(F.broadcast(albums.select(F.col("main_release_id").alias("release_id"), "master_id")), "release_id").select("master_id", "artist_id").distinct()
    return p.groupBy("master_id").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.transform(F.sort_array(F.collect_list("artist_id")), lambda x: x.cast("string")), ",").alias("artist_ids"))

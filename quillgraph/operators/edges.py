"""The co-credit edge relation: who contributed to the same recording, with a release as evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.plans.lens import Model
from quillgraph.policies import Policy


@dataclass(frozen=True)
class EvidencePreference:
    """Which release stands for a pair: preferred ones first, then those without caveats (worst tier first), then main
    releases, then the lowest id. The set of pairs does not depend on it."""

    preferred: tuple[int, ...] = ()
    prefer_main: bool = True


def _making(model: Model, policy: Policy) -> DataFrame:
    """Credits that can make an edge, on any release."""
    c = model.credits.where(R.is_playable() & R.not_placeholder(F.col("artist_id"), policy) & ~R.edge_ineligible(F.col("role_text"), policy))
    return c.select("release_id", "track_index", "track_title", "credit_scope", "artist_id")


def _on_releases(rows: DataFrame, model: Model, policy: Policy, format_policy: DataFrame | None) -> DataFrame:
    """Rows of the releases that can make an edge: those whose title is no variant's, or those the format policy allows."""
    releases = model.releases.select("release_id", "title")
    if format_policy is None:
        releases = releases.where(~R.variant_title(F.col("title"), policy.variant_release_pattern))
    else:
        rows = rows.join(format_policy.where("decision = 'allow'").select("release_id"), "release_id", "left_semi")
    return rows.join(releases.select("release_id"), "release_id", "left_semi")


def edge_credits(model: Model, policy: Policy, format_policy: DataFrame | None = None) -> DataFrame:
    """Credits that can make an edge."""
    return _on_releases(_making(model, policy), model, policy, format_policy)


def release_shapes(credits: DataFrame, policy: Policy) -> DataFrame:
    """Per release: whether it is shaped like an album, and whether it is billed to one artist only."""
    of = lambda scope: F.countDistinct(F.when(F.col("credit_scope") == scope, F.col("artist_id")))
    shape = credits.groupBy("release_id").agg(of("track_artist").alias("track_artists"), of("release_artist").alias("billed"), F.countDistinct("artist_id").alias("artists"))
    return shape.select("release_id", "track_artists", "billed", "artists", ((F.col("track_artists") < policy.compilation_threshold) & F.col("artists").between(2, policy.max_artists_per_release)).alias("album"), (F.col("billed") == 1).alias("single"))


def _pairs(xs: Column, ys: Column, rule: str, fit) -> Column:
    """(a, b, rule) of different artists for which fit(a, b)."""
    every = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("a"), y.alias("b"), F.lit(rule).alias("rule")))))
    return F.filter(every, lambda e: (e["a"] != e["b"]) & fit(e["a"], e["b"]))


def directed_edges(model: Model, policy: Policy, format_policy: DataFrame | None = None) -> DataFrame:
    """All directed (artist_a_id, artist_b_id, release_id, rule) before they are collapsed to one release a pair.

    Credits are dealt out by release once. On that partitioning they are gathered by track and then by release, the releases are
    joined, and the rules are read off the arrays: same_recording (an artist of a track with others credited on it, one of
    them billed), co_performers (billed artists of a track of an album) and release_scope (billed artists of an album with those
    credited for all of it). A track's own artists perform it; where an album billed to one artist names none, that artist. Pairs are
    made within tracks and albums of a bounded number of artists only.
    """
    studio = lambda c: ~R.variant_title(c, policy.variant_track_pattern)
    who, scope = F.col("artist_id"), F.col("credit_scope")
    tracks = _making(model, policy).repartition("release_id").groupBy("release_id", "track_index").agg(
        F.min("track_title").alias("title"), F.collect_set(who).alias("artists"), F.collect_set(F.when(scope == "track_artist", who)).alias("own"),
        F.collect_list(F.when((scope != "track_artist") & studio(F.col("track_title")), who)).alias("others"),
        F.collect_set(F.when(scope == "release_artist", who)).alias("billed"), F.collect_list(F.when(scope == "release_credit", who)).alias("wide"),
    )
    small = F.col("track_index").isNotNull() & (F.size("artists") <= policy.max_artists_per_track)
    releases = tracks.groupBy("release_id").agg(
        F.collect_list(F.when(small, F.struct(studio(F.col("title")).alias("studio"), "own", "others"))).alias("tracks"), F.array_distinct(F.flatten(F.collect_list("artists"))).alias("artists"),
        F.size(F.array_distinct(F.flatten(F.collect_list("own")))).alias("track_artists"), F.array_distinct(F.flatten(F.collect_list("billed"))).alias("billed"), F.flatten(F.collect_list("wide")).alias("wide"),
    )
    album = (F.col("track_artists") < policy.compilation_threshold) & F.size("artists").between(2, policy.max_artists_per_release)
    releases = _on_releases(releases.withColumn("album", album), model, policy, format_policy)
    none, billed = F.array().cast("array<long>"), F.col("billed")
    performers = lambda t: F.when(F.size(t["own"]) > 0, t["own"]).when(F.col("album") & (F.size(billed) == 1), billed).otherwise(none)
    is_billed = lambda x: F.array_contains(billed, x)
    same = F.flatten(F.transform("tracks", lambda t: _pairs(performers(t), t["others"], "same_recording", lambda a, b: is_billed(a) | is_billed(b))))
    both = lambda t: F.array_intersect(performers(t), billed)
    together = F.flatten(F.transform(F.filter("tracks", lambda t: F.col("album") & t["studio"]), lambda t: _pairs(both(t), both(t), "co_performers", lambda a, b: F.lit(True))))
    wide = _pairs(F.when(F.col("album"), billed).otherwise(none), F.col("wide"), "release_scope", lambda a, b: F.lit(True))
    mirrored = F.flatten(F.transform(F.concat(same, wide), lambda e: F.array(e, F.struct(e["b"].alias("a"), e["a"].alias("b"), e["rule"].alias("rule")))))
    edges = releases.select("release_id", F.explode(F.concat(mirrored, together)).alias("_e"))
    return edges.select(F.col("_e.a").alias("artist_a_id"), F.col("_e.b").alias("artist_b_id"), "release_id", F.col("_e.rule").alias("rule"))


def caveat_flags(formats: DataFrame, tiers: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Per release a bit for each caveat tier that any of its format descriptions falls in (worst tier highest)."""
    n = len(tiers)
    hit = [F.max(_any_of(tier)).cast("int") for tier in tiers]
    bits = sum((F.coalesce(h, F.lit(0)) * (1 << (n - 1 - i)) for i, h in enumerate(hit)), F.lit(0))
    return formats.groupBy("release_id").agg(bits.cast("int").alias("caveats"))


def _any_of(words: tuple[str, ...]) -> Column:
    known = F.array(*[F.lit(w) for w in sorted(set(words))])
    return F.coalesce(F.arrays_overlap(F.col("descriptions"), known), F.lit(False))


def credit_edges(model: Model, policy: Policy, format_policy: DataFrame | None = None, preference: EvidencePreference | None = None) -> DataFrame:
    """Directed, symmetric edges, one release per pair: the lowest, or the preferred one."""
    directed = directed_edges(model, policy, format_policy)
    if preference is None:
        return directed.groupBy("artist_a_id", "artist_b_id").agg(F.min("release_id").alias("release_id"))
    pairs = directed.select("artist_a_id", "artist_b_id", "release_id").distinct()
    main = model.releases.select("release_id", F.coalesce("master_is_main_release", F.lit(False)).alias("_main")) if preference.prefer_main else model.releases.select("release_id", F.lit(True).alias("_main"))
    ranked = main.join(caveat_flags(model.release_formats, policy.caveat_tiers), "release_id", "left").select(
        "release_id",
        F.struct(
            (~F.col("release_id").isin(*preference.preferred)).alias("other") if preference.preferred else F.lit(False).alias("other"),
            F.coalesce("caveats", F.lit(0)).alias("caveats"),
            (~F.col("_main")).alias("variant"),
            F.col("release_id").alias("id"),
        ).alias("_rank"),
    )
    best = pairs.join(ranked, "release_id").groupBy("artist_a_id", "artist_b_id").agg(F.min("_rank").alias("_rank"))
    return best.select("artist_a_id", "artist_b_id", F.col("_rank.id").alias("release_id"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("artist_a_id").alias("artist_id")).agg(F.count(F.lit(1)).alias("degree"))


def artist_names(credits: DataFrame) -> DataFrame:
    """Each artist's most credited spelling, the first in order among equals."""
    counted = credits.where(R.is_playable()).groupBy("artist_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("artist_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "name"))["name"].alias("name"))


def top_connected(model: Model, policy: Policy, limit: int = 20) -> DataFrame:
    """The most connected artists with their names: degree falling, id rising."""
    top = degrees(credit_edges(model, policy)).orderBy(F.desc("degree"), "artist_id").limit(limit)
    return top.join(artist_names(model.credits), "artist_id").select("artist_id", "name", "degree")


def graph_stats(edges: DataFrame) -> DataFrame:
    """Artists with an edge, undirected edges, evidence releases, highest degree."""
    d = degrees(edges)
    e = edges.agg((F.count(F.lit(1)) / 2).cast("long").alias("edges"), F.countDistinct("release_id").alias("evidence_releases"))
    return d.agg(F.count(F.lit(1)).alias("artists"), F.max("degree").alias("max_degree")).crossJoin(e)


def window_rank(df: DataFrame, by: list, order: list, k: int) -> DataFrame:
    """The first k rows of each group under a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")

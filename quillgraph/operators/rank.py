"""Albums: ranking, resolution of titles and ids, review of candidates, assembly of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.operators.edges import window_rank
from quillgraph.plans.lens import Model
from quillgraph.policies import Policy


def album_scores(model: Model, policy: Policy, allowed: DataFrame | None = None) -> DataFrame:
    """All albums with a billed artist: variants times credit rows is the score."""
    r = model.releases.where("master_id IS NOT NULL")
    variants = r.groupBy("master_id").agg(
        F.count(F.lit(1)).alias("variant_count"),
        F.min(F.when(F.col("master_is_main_release"), F.col("release_id"))).alias("main_release_id"),
        F.min(F.when(F.col("master_is_main_release"), F.struct("release_id", "title", "released"))).alias("_t"),
    )
    counts = model.credits.groupBy("release_id").agg(F.count(F.lit(1)).alias("n")).join(r.select("release_id", "master_id"), "release_id").groupBy("master_id").agg(F.sum("n").alias("credit_rows"))
    billed = model.credits.where((F.col("credit_scope") == "release_artist") & F.col("playable_identity") & F.col("artist_id").isNotNull() & R.not_placeholder(F.col("artist_id"), policy))
    billed = billed.groupBy(F.col("release_id").alias("main_release_id")).agg(F.min(F.struct("artist_id", "name")).alias("_a"))
    out = variants.join(counts, "master_id", "left").join(billed, "main_release_id")
    studio = model.masters.where(~R.non_studio_master(F.col("genres"), F.col("styles"), policy)).select("master_id")
    out = out.join(studio, "master_id", "left_semi")
    if allowed is not None:
        out = out.join(allowed.select(F.col("release_id").alias("main_release_id")), "main_release_id", "left_semi")
    rows = F.coalesce("credit_rows", F.lit(0))
    return out.select(
        "master_id", F.col("_t.title").alias("title"), "variant_count", rows.alias("credit_rows"), (F.col("variant_count") * rows).alias("score"), "main_release_id",
        F.col("_a.artist_id").alias("artist_id"), F.col("_a.name").alias("artist_name"), R.year_of(F.col("_t.released")).alias("year"),
    )


def rank_albums(model: Model, policy: Policy, limit: int = 200, allowed: DataFrame | None = None) -> DataFrame:
    return album_scores(model, policy, allowed).orderBy(F.desc("score"), "master_id").limit(limit)


def album_catalog(scores: DataFrame, editorial: DataFrame, target: int) -> DataFrame:
    """Editorial albums first, then by score; one album an artist; up to the target."""
    ordered = scores.join(editorial.select("master_id", F.lit(0).alias("_tier")), "master_id", "left").withColumn("_tier", F.coalesce("_tier", F.lit(1)))
    best = window_rank(ordered, ["artist_id"], ["_tier", F.desc("score"), "master_id"], 1)
    return best.orderBy("_tier", F.desc("score"), "master_id").limit(target).select("master_id", "artist_id", "score", (F.col("_tier") == 0).alias("editorial"))


def resolve_candidates(model: Model, candidates: DataFrame, policy: Policy) -> DataFrame:
    """Candidates (position, title, artist, release_hint): by hint, redirected to the main release of its master, else by
    title and artist without regard to case, main releases first; one album an artist, the first in order. What a title and an
    artist stand for is found once for all candidates, so that no row is made for each release that a candidate could mean."""
    r = model.releases.select("release_id", "master_id", "title", F.coalesce("master_is_main_release", F.lit(False)).alias("main"))
    billed = model.credits.where(F.col("credit_scope") == "release_artist").where(R.not_placeholder(F.col("artist_id"), policy)).groupBy("release_id").agg(F.min(F.struct("artist_id", "name")).alias("_a"))
    known = r.join(billed, "release_id").select("release_id", "master_id", "title", "main", "_a.artist_id", F.col("_a.name").alias("name"))
    main = known.groupBy("master_id").agg(F.min(F.struct((~F.col("main")).alias("v"), "release_id", "artist_id")).alias("_m"))
    hint = candidates.join(known.select(F.col("release_id").alias("release_hint"), "master_id"), "release_hint").join(main, "master_id").select("position", F.lit("hint").alias("how"), F.col("_m.release_id").alias("release_id"), F.col("_m.artist_id").alias("artist_id"))
    low = lambda c: F.lower(F.trim(F.col(c)))
    named = known.groupBy(low("title").alias("_t"), low("name").alias("_n")).agg(F.min(F.struct((~F.col("main")).alias("v"), "release_id", "artist_id")).alias("_m"))
    rest = candidates.select("position", low("title").alias("_t"), low("artist").alias("_n")).join(hint.select("position"), "position", "left_anti")
    text = rest.join(named, ["_t", "_n"]).select("position", F.lit("text").alias("how"), F.col("_m.release_id").alias("release_id"), F.col("_m.artist_id").alias("artist_id"))
    found = F.struct("position", "how", "release_id")
    return hint.unionByName(text).groupBy("artist_id").agg(F.min(found).alias("_f")).select("_f.position", "_f.how", "_f.release_id", "artist_id")


def review_candidates(model: Model, scores: DataFrame, catalog: DataFrame, policy: Policy) -> DataFrame:
    """For albums outside the catalog: their performers, and how many of them are new to it."""
    perf = model.credits.where(R.is_playable() & R.not_placeholder(F.col("artist_id"), policy) & R.performer_role(F.col("role_text"), policy)).select("release_id", "artist_id").distinct()
    have = catalog.select("master_id").join(scores.select("master_id", F.col("main_release_id").alias("release_id")), "master_id").join(perf, "release_id").select("artist_id").distinct().withColumn("_known", F.lit(1))
    new = scores.select("master_id", "main_release_id", "score").join(catalog.select("master_id"), "master_id", "left_anti").withColumnRenamed("main_release_id", "release_id").join(perf, "release_id").select("master_id", "score", "artist_id")
    return new.join(have, "artist_id", "left").groupBy("master_id", "score").agg(F.count(F.lit(1)).alias("performers"), F.count_if(F.col("_known").isNull()).alias("new_performers"))


def evidence_registry(edges: DataFrame, model: Model, policy: Policy, caveats: DataFrame) -> DataFrame:
    """Every evidence release once, with year, edges it stands for, and caveats."""
    used = edges.groupBy("release_id").agg(F.count(F.lit(1)).alias("edges"))
    year = R.year_of(F.col("released"))
    return used.join(model.releases.select("release_id", "title", F.when(year.between(1900, 2100), year).alias("year"), "master_id"), "release_id").join(caveats, "release_id", "left").select(
        "release_id", "title", "year", "master_id", "edges", F.coalesce("caveats", F.lit(0)).alias("caveats"), F.coalesce("severity", F.lit(0)).alias("severity")
    )

"""Bounded corpora: expansion of a seed by one hop, and corpora around given artists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.plans.lens import Model
from quillgraph.policies import Policy


class ExpansionTooLarge(RuntimeError):
    """More releases would be retained than allowed; nothing was written."""


@dataclass(frozen=True)
class Corpus:
    model: Model
    frontier: DataFrame
    seeds: DataFrame


def frontier_artists(model: Model, seeds: DataFrame, policy: Policy) -> DataFrame:
    """Artists with a performer's credit on a seed release."""
    c = model.credits.where(F.col("playable_identity") & F.col("artist_id").isNotNull() & R.not_placeholder(F.col("artist_id"), policy) & R.performer_credit(F.col("role_text"), policy))
    return c.join(seeds.select("release_id"), "release_id", "left_semi").select("artist_id").distinct()


def retained_releases(model: Model, frontier: DataFrame, policy: Policy) -> DataFrame:
    """Releases on which a frontier artist has a performer's credit."""
    c = model.credits.where(F.col("playable_identity") & R.performer_credit(F.col("role_text"), policy))
    return c.join(frontier, "artist_id", "left_semi").select("release_id").distinct()


def expand_one_hop(model: Model, seeds: DataFrame, policy: Policy, max_releases: int | None = None) -> Corpus:
    """All rows of the releases within one hop of the seed releases."""
    frontier = frontier_artists(model, seeds, policy)
    return _corpus(model, frontier, seeds.join(model.releases.select("release_id"), "release_id", "left_semi"), policy, max_releases)


def topic_corpus(model: Model, artists: DataFrame, policy: Policy, hops: int = 1, max_releases: int | None = None) -> Corpus:
    """All rows of the releases of the given artists, or (2 hops) of those of the artists met there."""
    frontier = artists.select("artist_id").distinct()
    seeds = retained_releases(model, frontier, policy)
    if hops > 1:
        frontier = frontier.unionByName(frontier_artists(model, seeds, policy)).distinct()
    return _corpus(model, frontier, seeds, policy, max_releases)


def _corpus(model: Model, frontier: DataFrame, seeds: DataFrame, policy: Policy, max_releases: int | None) -> Corpus:
    kept = retained_releases(model, frontier, policy)
    if max_releases is not None and (n := kept.count()) > max_releases:
        raise ExpansionTooLarge(f"{n} releases exceed the bound of {max_releases}")
    of = lambda df: df.join(kept, "release_id", "left_semi")
    releases = of(model.releases)
    masters = model.masters.join(releases.select("master_id"), "master_id", "left_semi")
    return Corpus(Model(releases, of(model.credits), of(model.release_formats), masters, model.artist_relations), frontier, seeds)


def self_check(corpus: Corpus, policy: Policy) -> DataFrame:
    """Counts that must be zero: orphan credits and formats, retained releases without a frontier credit, seeds lost."""
    m = corpus.model
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    anchored = retained_releases(m, corpus.frontier, policy)
    return (
        n(m.credits.join(m.releases, "release_id", "left_anti"), "orphan_credits")
        .crossJoin(n(m.release_formats.join(m.releases, "release_id", "left_anti"), "orphan_formats"))
        .crossJoin(n(m.releases.join(anchored, "release_id", "left_anti"), "unanchored_releases"))
        .crossJoin(n(corpus.seeds.join(m.releases, "release_id", "left_anti"), "lost_seeds"))
    )

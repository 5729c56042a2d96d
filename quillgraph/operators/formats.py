"""Release formats: the studio-album policy, caveats, and how the policy compares with a title filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.operators.edges import caveat_flags
from quillgraph.plans.lens import Model
from quillgraph.policies import Policy


def format_policy(model: Model, policy: Policy) -> DataFrame:
    """release_id, decision (allow / exclude / review), shape and signals of each release.

    An excluded descriptor wins; an album descriptor allows, but for titles that sound live; all else is for review.
    """
    descriptors = model.release_formats.groupBy("release_id").agg(F.array_distinct(F.flatten(F.collect_list(F.transform(F.coalesce("descriptions", F.array().cast("array<string>")), R.squeezed)))).alias("descriptors"))
    rows = model.releases.select("release_id", "title").join(descriptors, "release_id", "left")
    d = F.col("descriptors")
    excluded = F.array_compact(F.array(*[F.when(F.array_contains(d, w), F.lit(s)) for w, s in policy.excluded_descriptors.items()]))
    album = F.array_contains(d, policy.album_descriptor)
    live = R.variant_title(F.col("title"), policy.live_title_pattern)
    one = lambda *s: F.array(*[F.lit(x) for x in s])
    rows = rows.withColumn("_x", excluded)
    signals = (
        F.when(d.isNull(), one("missing_formats")).when(F.size("_x") > 0, F.col("_x")).when(album & live, one("explicit_album", "title_signals_live_or_soundtrack"))
        .when(album, one("explicit_album")).otherwise(one("album_descriptor_missing"))
    )
    decision = F.when(d.isNull(), "review").when(F.size("_x") > 0, "exclude").when(album & ~live, "allow").otherwise("review")
    shape = F.when(decision == "allow", "studio_album").when((decision == "exclude") & F.array_contains(F.col("_x"), "explicit_compilation"), "compilation").otherwise("unknown")
    return rows.select("release_id", decision.alias("decision"), shape.alias("shape"), F.array_join(signals, ",").alias("signals"))


def scoring_index(policy_rows: DataFrame) -> DataFrame:
    return policy_rows.where("decision = 'allow'").select("release_id")


def shadow_report(model: Model, policy: Policy) -> DataFrame:
    """How often the title filter and the format policy agree and disagree."""
    p = format_policy(model, policy).join(model.releases.select("release_id", "title"), "release_id")
    title = F.when(R.variant_title(F.col("title"), policy.variant_release_pattern), "title_exclude").otherwise("title_keep")
    return p.groupBy(title.alias("title_filter"), "decision").agg(F.count(F.lit(1)).alias("releases"))


def release_caveats(model: Model, policy: Policy) -> DataFrame:
    """Caveat bits per release and their worst severity."""
    flags = caveat_flags(model.release_formats, policy.caveat_tiers)
    n, worst = len(policy.caveat_tiers), F
    for i in range(n):
        worst = worst.when(F.col("caveats").bitwiseAND(F.lit(1 << (n - 1 - i))) != 0, F.lit(n - i))
    return flags.select("release_id", "caveats", worst.otherwise(F.lit(0)).cast("int").alias("severity"))

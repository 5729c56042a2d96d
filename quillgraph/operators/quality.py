"""Validation and profiling of datasets: one aggregation per table, not one job per figure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import roles as R
from quillgraph.plans.lens import Model
from quillgraph.policies import Policy


def _n(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def dataset_metrics(model: Model) -> DataFrame:
    """One row of counts and invariants of the dataset."""
    r = model.releases.agg(F.count(F.lit(1)).alias("releases"), F.countDistinct("release_id").alias("distinct_releases"), F.countDistinct("master_id").alias("masters"))
    c = model.credits.agg(
        F.count(F.lit(1)).alias("credits"), F.count_if(F.col("artist_id").isNotNull()).alias("linked_credits"), F.count_if("playable_identity").alias("playable_credits"),
        F.countDistinct("artist_id").alias("artists"), F.countDistinct(F.when(F.col("credit_scope") == "release_artist", F.col("artist_id"))).alias("billed_artists"),
    )
    orphans = _n(model.credits.join(model.releases, "release_id", "left_anti"), "orphan_credits").crossJoin(_n(model.release_formats.join(model.releases, "release_id", "left_anti"), "orphan_formats"))
    return r.crossJoin(c).crossJoin(orphans)


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and nulls of each column, as rows."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select("_rows", F.explode(F.map_from_arrays(R.literals(columns), F.array(*columns)))).select(F.col("key").alias("column_name"), F.col("_rows").alias("rows"), F.col("value").alias("nulls"))


def date_shapes(dates: DataFrame, column: str) -> DataFrame:
    """Counts of the shapes of free-text dates."""
    x = F.col(column)
    shape = (
        F.when(x.isNull() | (F.trim(x) == ""), "empty").when(x.rlike(r"^[0-9]{4}$"), "year").when(x.rlike(r"^[0-9]{4}-[0-9]{2}-00$"), "year_month")
        .when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "full_date").otherwise("other")
    )
    return dates.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("rows"))


def role_lengths(model: Model) -> DataFrame:
    """Credits by length of their role texts, with the longest."""
    n = F.char_length("role_text")
    bucket = F.when(F.col("role_text").isNull(), "null").when(n <= 8, "short").when(n <= 14, "medium").otherwise("long")
    return model.credits.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("credits"), F.coalesce(F.max(n), F.lit(0)).alias("longest"))


def top_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties in their order."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.col("value").asc_nulls_last()).limit(k)


def per_release_averages(model: Model) -> DataFrame:
    r = _n(model.releases, "r")
    c = model.credits.agg(F.count(F.lit(1)).alias("c"))
    f = _n(model.release_formats, "f")
    return r.crossJoin(c).crossJoin(f).select((F.col("c") / F.col("r")).alias("credits_per_release"), (F.col("f") / F.col("r")).alias("formats_per_release"))


def decades(model: Model) -> DataFrame:
    year = R.year_of(F.col("released"))
    return model.releases.where(year.isNotNull()).groupBy(R.decade_of(year).alias("decade")).agg(F.count(F.lit(1)).alias("releases"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def role_coverage(model: Model, policy: Policy) -> DataFrame:
    """Share of credits with a known category, in percent."""
    known = R.primary_category(R.role_categories(F.col("role_text"), policy)) != "unknown"
    return model.credits.agg(F.count(F.lit(1)).alias("credits"), F.count_if(known).alias("classified"), F.round(100.0 * F.count_if(known) / F.count(F.lit(1)), 2).alias("percent"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def placeholder_candidates(model: Model, pattern: str, least: int = 1) -> DataFrame:
    """Artists whose names look like placeholders, with the number of their releases."""
    c = model.credits.where(F.lower("name").rlike(pattern))
    return c.groupBy("artist_id").agg(F.min("name").alias("name"), F.countDistinct("release_id").alias("releases")).where(F.col("releases") >= least)

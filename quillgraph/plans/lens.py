"""The credit model over the test tables: releases from orders, credits from lineitem, and so on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    """The tables that operators work on."""

    releases: DataFrame
    credits: DataFrame
    release_formats: DataFrame
    masters: DataFrame
    artist_relations: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lens(spark: SparkSession, sf_dir: str) -> Model:
    t = lambda name: read(spark, sf_dir, name)
    first = Window.partitionBy("o_custkey")
    people = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    releases = (
        t("orders")
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", F.min("o_orderkey").over(first).alias("_main"))
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("release_id"), F.col("o_orderpriority").alias("title"), F.col("n_name").alias("country"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("released"), F.col("o_custkey").alias("master_id"),
            (F.col("o_orderkey") == F.col("_main")).alias("master_is_main_release"), F.col("o_orderstatus").alias("data_quality"),
        )
    )
    parts = t("part").select("p_partkey", "p_name", "p_type", "p_brand")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    line = F.col("l_linenumber")
    scope = F.when(line == 1, "release_artist").when(line == 2, "release_credit").when(line <= 4, "track_artist").otherwise("track_credit")
    role = F.when(F.col("l_returnflag") == "A", F.col("p_type")).when(F.col("l_returnflag") == "R", F.concat_ws(", ", "p_type", "p_brand"))
    one = F.struct(scope.alias("scope"), F.when(line > 2, F.col("l_suppkey") % 3).cast("int").alias("track"), role.alias("role"))
    two = F.struct(F.lit("track_artist").alias("scope"), (F.col("l_suppkey") % 3).cast("int").alias("track"), F.lit(None).cast("string").alias("role"))
    credits = joined.withColumn("_c", F.explode(F.when(line == 1, F.array(one, two)).otherwise(F.array(one)))).select(
        F.col("l_orderkey").alias("release_id"), F.col("_c.track").alias("track_index"), F.lit(None).cast("string").alias("track_title"),
        F.col("_c.scope").alias("credit_scope"), F.col("l_partkey").alias("artist_id"), F.col("p_name").alias("name"), F.col("_c.role").alias("role_text"),
        F.lit(True).alias("playable_identity"),
    )
    formats = joined.select(F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").alias("format_index"), F.col("p_type").alias("format_name"), F.array("p_type", "p_brand").alias("descriptions"))
    masters = t("customer").select(F.col("c_custkey").alias("master_id"), F.col("c_name").alias("title"), F.array("c_mktsegment").alias("genres"), F.array().cast("array<string>").alias("styles"))
    supplier = t("supplier")
    relations = supplier.select(F.col("s_suppkey").alias("artist_id"), F.col("s_nationkey").cast("long").alias("related_artist_id"), F.lit("member_of").alias("relation")).unionByName(
        supplier.where("s_suppkey % 2 = 0").select(F.col("s_nationkey").cast("long").alias("artist_id"), F.col("s_suppkey").alias("related_artist_id"), F.lit("has_member").alias("relation"))
    )
    return Model(releases, credits, formats, masters, relations)


#: The same model as DuckDB common table expressions, for the SQL side of the comparison.
SQL = """
releases AS (
  SELECT o_orderkey AS release_id, o_orderpriority AS title, n_name AS country, strftime(o_orderdate, '%Y-%m-%d') AS released,
         o_custkey AS master_id, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS master_is_main_release, o_orderstatus AS data_quality
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
lines AS (
  SELECT *, CASE WHEN l_returnflag = 'A' THEN p_type WHEN l_returnflag = 'R' THEN p_type || ', ' || p_brand END AS role_text
  FROM lineitem JOIN part ON l_partkey = p_partkey),
credits AS (
  SELECT l_orderkey AS release_id, CAST(CASE WHEN l_linenumber > 2 THEN l_suppkey % 3 END AS INTEGER) AS track_index, CAST(NULL AS VARCHAR) AS track_title,
         CASE WHEN l_linenumber = 1 THEN 'release_artist' WHEN l_linenumber = 2 THEN 'release_credit' WHEN l_linenumber <= 4 THEN 'track_artist' ELSE 'track_credit' END AS credit_scope,
         l_partkey AS artist_id, p_name AS name, role_text, TRUE AS playable_identity FROM lines
  UNION ALL
  SELECT l_orderkey, CAST(l_suppkey % 3 AS INTEGER), CAST(NULL AS VARCHAR), 'track_artist', l_partkey, p_name, CAST(NULL AS VARCHAR), TRUE FROM lines WHERE l_linenumber = 1),
release_formats AS (
  SELECT l_orderkey AS release_id, l_linenumber AS format_index, p_type AS format_name, [p_type, p_brand] AS descriptions FROM lines),
masters AS (
  SELECT c_custkey AS master_id, c_name AS title, [c_mktsegment] AS genres, CAST([] AS VARCHAR[]) AS styles FROM customer),
artist_relations AS (
  SELECT s_suppkey AS artist_id, CAST(s_nationkey AS BIGINT) AS related_artist_id, 'member_of' AS relation FROM supplier
  UNION ALL SELECT CAST(s_nationkey AS BIGINT), s_suppkey, 'has_member' FROM supplier WHERE s_suppkey % 2 = 0)
"""

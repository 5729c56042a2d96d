"""A reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import Buckets, id_order

ROUNDS = 6

#: Walks taken at most. The domain exceeds the rows by less than its shorter side, so a walk leaves the rows with a
#: chance under 1 / sqrt(rows): up to 4,096 rows no cycle is longer than this, beyond that the chance is under rows ** -32
#: (and such a row raises an error rather than getting a wrong place).
WALKS = 65


def domain(rows: int) -> tuple[int, int]:
    """Sides (a, b) of a near-square domain with rows <= a * b < rows + a."""
    a = math.isqrt(max(rows, 1) - 1) + 1
    return a, -(-max(rows, 1) // a)


def _pass(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of an additive Feistel network over the mixed radix (a, b): a permutation of 0 .. a * b - 1."""
    halves = F.struct(((x - F.pmod(x, F.lit(b))) / F.lit(b)).cast("long").alias("left"), F.pmod(x, F.lit(b)).alias("right"))

    def turn(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["left"] + F.pmod(F.xxhash64(s["right"], F.lit(seed), k), F.lit(a)), F.lit(a))).otherwise(s["left"]).alias("left"),
            F.when(even, s["right"]).otherwise(F.pmod(s["right"] + F.pmod(F.xxhash64(s["left"], F.lit(seed), k), F.lit(b)), F.lit(b))).alias("right"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: s["left"] * F.lit(b).cast("long") + s["right"])


def shuffled(number: Column, rows: int, seed: int = 0) -> Column:
    """The place of a global row number (0 .. rows - 1) in the shuffle, computable for any row by itself."""
    a, b = domain(rows)
    n = F.lit(rows).cast("long")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), _pass(number.cast("long"), a, b, seed), lambda x, _: F.when(x < n, x).otherwise(_pass(x, a, b, seed)))
    return F.transform(F.array(walk), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long")))[0]


def number_rows(df: DataFrame, key: str, ties: list[str]) -> tuple[DataFrame, int]:
    """df with `row_number` from 0 in ascending order of key (null first), then of ties. Only df's columns are shuffled,
    in buckets of bounded row counts; no task sees all rows. Also the count of rows."""
    b = Buckets(df, key)
    order = Window.partitionBy("_b").orderBy(id_order(key), *[F.col(t).asc_nulls_first() for t in ties])
    return df.withColumn("_b", b.bucket()).withColumn("row_number", (b.offset() + F.row_number().over(order) - 1).cast("long")).drop("_b"), b.rows


def shard_documents(documents: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """Each document's shard and gapless slot within it, under the law `rows`: counts differ by at most one.

    A row's place p is the Feistel image of its global row number; shard = p mod shards, slot = p div shards. Rows are
    numbered by doc_id (null first); rows of equal doc_id by crc32, size and md5 of their texts, so that only rows alike in all
    of these are interchangeable. Null texts weigh 16 and have the crc32 of an empty text. An empty table gives an empty
    result; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.md5(text).alias("_md5"))
    numbered, n = number_rows(rows, "doc_id", ["text_crc32", "size", "_md5"])
    placed = numbered.withColumn("_p", shuffled(F.col("row_number"), n, seed))
    shard = F.pmod(F.col("_p"), F.lit(shards))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"), ((F.col("_p") - shard) / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )

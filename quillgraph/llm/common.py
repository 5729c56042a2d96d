"""Shared building blocks: durable intermediates, size-checked broadcasts, ordered numbering and components."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import components
from quillgraph.sources.scratch import discard, materialize

__all__ = ["Buckets", "components", "discard", "id_order", "map_batches", "materialize", "place", "small"]

#: Rows up to which a narrow side (ids and a few numbers, under 100 bytes a row, so 20 MB) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Most rows that one ordered bucket aims at.
BUCKET_ROWS = 65_536

_SMALLEST = -(2**63)


#: Rows and bytes of an Arrow batch on its way to Python, set for the session where it has the defaults: whole texts are
#: large, and a batch stands in the executor's direct memory and in the Python worker at once.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of bounded bytes, which gives memory back when a task ends: Python workers are
    reused, and what their allocators keep would add up beside the executor's heap from stage to stage."""

    def tidied(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow

        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

    conf = df.sparkSession.conf
    for key, (default, ours) in ARROW.items():
        if conf.get(key, default) == default:
            conf.set(key, ours)
    return df.mapInArrow(tidied, schema)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialized narrow frame only if its counted rows are within the limit; else leave it to a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def place(doc_id: str | Column, node: Column) -> Column:
    """A key to join documents by: doc_id, or where it is null a part of the key of the text (128 bits, see minhash.text_key).
    Where node is computed from the text, that is done for rows without doc_id only."""
    return F.coalesce(doc_id, F.conv(F.substring(F.hex(node), 1, 15), 16, 10).cast("long"))


def id_order(col: str) -> Column:
    """Ascending ids, null first."""
    return F.coalesce(F.col(col), F.lit(_SMALLEST))


class Buckets:
    """Ordered buckets of near-equal row counts over one integer column.

    The driver holds one bound and one count per bucket (16 bytes for every BUCKET_ROWS rows at scale). Bounds are quantiles of
    the column, so that skewed or sparse ids still give even buckets; all rows of one id share a bucket.
    """

    def __init__(self, df: DataFrame, col: str, bucket_rows: int = BUCKET_ROWS):
        ids = df.select(id_order(col).alias("_o"))
        self.col, self.rows = col, ids.count()
        n = max(-(-self.rows // bucket_rows), min(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.rows // 16), 1)
        bounds: list[int] = []
        if n > 1:
            q = ids.agg(F.percentile_approx("_o", [i / n for i in range(1, n)], F.lit(max(10_000, 4 * n))).alias("q")).first()["q"]
            bounds = sorted(set(q))
        self.bounds = bounds
        got = {r["_b"]: (r["n"], r["lo"]) for r in ids.select(self.bucket_of(F.col("_o")).alias("_b"), "_o").groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("lo")).collect()}
        self.filled = sorted(got)
        self.counts = [got.get(b, (0, 0))[0] for b in range(len(bounds) + 1)]
        self.lows = {b: got[b][1] for b in self.filled}

    def bucket_of(self, order: Column) -> Column:
        """How many bounds are at most the value: a binary search in the array of bounds."""
        if not self.bounds:
            return F.lit(0)
        bounds = F.array(*[F.lit(b) for b in self.bounds]) if len(self.bounds) < 64 else F.from_json(F.lit(str(self.bounds)), "array<bigint>")
        found, steps = F.lit(0), len(self.bounds).bit_length()
        if steps <= 6:
            for b in self.bounds:
                found = found + (order >= F.lit(b)).cast("int")
            return found
        size = len(self.bounds)
        state = F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi"))

        def step(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            right = (s["lo"] < s["hi"]) & (F.get(bounds, mid) <= order)
            return F.struct(
                F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"),
                F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), state, step)["lo"]

    def bucket(self) -> Column:
        return self.bucket_of(id_order(self.col))

    def offset(self) -> Column:
        """Rows in all earlier buckets, by bucket column `_b`."""
        sums = [0, *itertools.accumulate(self.counts)][:-1]
        return F.get(F.from_json(F.lit(str(sums)), "array<bigint>"), F.col("_b"))

"""Mixing sources to target weights by the cube method: balanced sampling of documents, source by source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bytewords import mix as _hash
from quillgraph.llm.common import map_batches, materialize, small
from quillgraph.llm.minhash import text_key

WEIGHTS = (5, 2, 1)
MOST = 3  # times that a document is taken at most

#: Documents of one source in a chunk; a chunk leaves two undecided at most, which meet in the next level's chunks.
CHUNK = 4096

#: Documents of a source's last chunk, of all sizes, that stay out of its flight for the landing.
LANDING = 14

_EPS = 1e-9


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return (null: 0)."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Each source's target: the sum of all sizes shared by weight (repeating in code point order, null last), none above
    `most` times its source's size; what a cap cuts off is shared among the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not over:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


class _Flight:
    """The flight phase of one chunk: three units at a time move along the null space of the balancing constraints
    (the size total and the number of documents stay as they are) until one of them is decided."""

    def __init__(self):
        self.units: list[list] = []  # [size, probability, hash, row]
        self.steps = 0

    def _uniform(self, h: int) -> float:
        self.steps += 1
        return (int(_hash(np.array([(h + self.steps * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0]) >> 11) / 2.0**53

    def _move(self, direction: list[float]) -> None:
        up = down = np.inf
        for (_, p, _, _), d in zip(self.units, direction, strict=False):
            if d > 0:
                up, down = min(up, (1 - p) / d), min(down, p / d)
            elif d < 0:
                up, down = min(up, p / -d), min(down, (1 - p) / -d)
        step = up if self._uniform(self.units[0][2] ^ self.units[-1][2]) * (up + down) < down else -down
        for u, d in zip(self.units, direction, strict=False):
            u[1] += step * d

    def _settled(self) -> list[list]:
        out, rest = [], []
        for u in self.units:
            if u[1] < _EPS or u[1] > 1 - _EPS:
                u[1] = float(round(u[1]))
                out.append(u)
            else:
                rest.append(u)
        self.units = rest
        return out

    def add(self, unit: list) -> list[list]:
        """Takes a unit in; returns the units that are decided by that."""
        self.units.append(unit)
        out = self._settled()
        while len(self.units) == 3:
            a, b, c = (u[0] for u in self.units)
            direction = [float(b - c), float(c - a), float(a - b)]
            scale = max(map(abs, direction))
            self._move([d / scale for d in direction] if scale else [1.0, -1.0, 0.0])
            out += self._settled()
        return out

    def land(self, kept: list[list]) -> list[list]:
        """Decides the last units (two at most) together with those kept for the landing: of all choices the one with the
        size total nearest to what was wanted, then the number of documents."""
        out = self.units + kept
        self.units = []
        if not out:
            return out
        size = np.array([u[0] for u in out], float)
        p = np.array([u[1] for u in out], float)
        bits = (np.arange(1 << len(out))[:, None] >> np.arange(len(out))) & 1
        off = np.abs(bits @ size - size @ p)
        best = np.lexsort((np.abs(bits.sum(1) - p.sum()), np.round(off)))[0]
        for u, x in zip(out, bits[best], strict=True):
            u[1] = float(x)
        return out


def _fly(columns: list[str]):
    """Runs the flights of sorted rows, chunk by chunk, with three units in memory; the last chunk of a source also lands."""
    s, c, n, z, p, h = (columns.index(x) for x in ("_s", "_chunk", "_chunks", "size", "_p", "_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, at, alone, schema, out, last = _Flight(), None, False, None, [], []

        def end() -> None:
            if alone:  # the whole last chunk of a source, at most about CHUNK units: units of all sizes stay for the landing
                k = min(LANDING, len(last))
                stay = {(2 * i + 1) * len(last) // (2 * k) for i in range(k)}
                for i, u in enumerate(last):
                    if i not in stay:
                        out.extend(flight.add(u))
                waiting = [u for i, u in enumerate(last) if i in stay]
                settled = [u for u in waiting if u[1] in (0, 1)]
                out.extend(settled + flight.land([u for u in waiting if 0 < u[1] < 1]))
                last.clear()
            out.extend(flight.units)
            flight.units = []

        def packed() -> pa.RecordBatch:
            rows = []
            for u in out:
                r = list(u[3])
                r[p] = u[1]
                rows.append(r)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            schema = b.schema
            for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (row[s], row[c]) != at:
                    end()
                    flight, at, alone = _Flight(), (row[s], row[c]), row[n] == 1
                unit = [row[z], row[p], row[h] % (1 << 64), row]
                if alone:
                    last.append(unit)
                else:
                    out += flight.add(unit)
            if out:
                yield packed()
        end()
        if out:
            yield packed()

    return run


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 23, keys: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, copies (times taken) and taken (words); with
    keys=True also `node`, the key of its text.

    A source with target r times its size takes each document floor(r) times, and samples once more with the fraction of r
    as every document's inclusion probability, by the cube method, balanced on words and documents. Chunks of a source
    fly independently (in order of falling size, so that small documents remain); what they leave undecided flies again
    until one chunk per source is left, whose last documents (LANDING and two) land on the nearest word total. Chance is a hash of
    doc_id, text and, among rows equal in both, a number; the order is total up to such rows, so reruns agree whatever the order of
    the rows and their partitions. The driver holds one size and target per source.
    Null texts have size 0, null sources are a source. Repeated rows and those of clashing or null doc_ids are separate documents. An
    empty table gives an empty result.
    """
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_key().alias("node"))
    rows = materialize(rows.groupBy("doc_id", "source", "size", "node").agg(F.count(F.lit(1)).alias("_rows")), "sizes")
    known = {r["source"]: (int(r["size"]), r["n"]) for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("_rows")).alias("size"), F.sum("_rows").alias("n")).collect()}
    spark = documents.sparkSession
    goal = targets({s: v[0] for s, v in known.items()}, weights, most)
    plan = []
    for i, (s, (size, n)) in enumerate(sorted(known.items(), key=lambda x: (x[0] is None, x[0] or ""))):
        ratio = min(goal[s] / size, float(most)) if size else 0.0
        base = int(ratio + _EPS)
        fraction = ratio - base if ratio - base > _EPS else 0.0
        plan.append((s, i, size, goal[s], base, fraction, max(1, -(-n // CHUNK))))
    schema = "_source string, _s int, source_size long, target double, _base int, _p double, _chunks int"
    sources = spark.createDataFrame(plan, schema)
    units = rows.join(small(sources, len(plan)), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # equal rows get numbers, blocks of them first, so that many equal ones are not written by one task
    units = units.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / CHUNK))))
    if rows.where(F.col("_rows") > CHUNK).limit(1).count():
        units = units.repartition("doc_id", "node", "_block")
    last = F.least(F.col("_rows"), (F.col("_block") + 1) * CHUNK) - 1
    units = units.withColumn("_i", F.explode(F.sequence(F.col("_block") * CHUNK, last))).withColumn("_h", F.xxhash64("doc_id", "node", "_i", F.lit(seed))).drop("_block", "_i", "_rows")
    decided = None
    level = 0
    while True:
        salted = units.withColumn("_chunk", F.pmod(F.xxhash64("_h", "size", F.lit(level)), F.col("_chunks")).cast("int"))
        ordered = salted.repartition("_s", "_chunk").sortWithinPartitions("_s", "_chunk", F.desc("size"), "_h", "doc_id", "node")
        flown = materialize(map_batches(ordered, _fly(ordered.columns), ordered.schema), "flown")
        done = flown.where("_p = 0 or _p = 1")
        decided = done if decided is None else decided.unionByName(done)
        if all(p[-1] == 1 for p in plan):
            break
        plan = [(*p[:-1], max(1, -(-2 * p[-1] // CHUNK)) if p[-1] > 1 else 1) for p in plan]
        chunks = spark.createDataFrame([(p[1], p[-1]) for p in plan], "_s int, _chunks int")
        units = flown.where("_p > 0 and _p < 1").drop("_chunk", "_chunks").join(small(chunks, len(plan)), "_s")
        level += 1
    copies = (F.col("_base") + F.col("_p")).cast("int")
    return decided.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), *(["node"] if keys else []))


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """documents with each row as often as the mix takes it (not at all if zero), all columns as they were."""
    chosen = mix_sources(documents, keys=True, **options)
    copies = materialize(chosen.groupBy("doc_id", F.col("node").alias("_quill_key"), F.col("source").alias("_quill_source")).agg(F.sum("copies").cast("int").alias("_quill_copies"), F.count(F.lit(1)).alias("_quill_rows")), "copies")
    again = copies.where("_quill_rows > 1").limit(1).count()
    keyed = documents.withColumn("_quill_key", text_key())
    if again:  # repeated rows: one of them stands for all
        keyed = keyed.dropDuplicates(["doc_id", "_quill_key", "source"])
    c = small(copies).withColumnRenamed("doc_id", "_quill_id").withColumnRenamed("_quill_key", "_quill_node")
    on = keyed["doc_id"].eqNullSafe(c["_quill_id"]) & (keyed["_quill_key"] == c["_quill_node"]) & keyed["source"].eqNullSafe(c["_quill_source"])
    taken = keyed.join(c, on).where("_quill_copies > 0").withColumn("_quill_copy", F.explode(F.sequence(F.lit(1), F.col("_quill_copies"))))
    return taken.select(*documents.columns)

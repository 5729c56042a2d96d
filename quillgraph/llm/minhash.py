"""Near-duplicate documents: ProbMinHash signatures of weighted word shingles, banding, and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import bytewords
from quillgraph.llm.common import components, discard, map_batches, materialize, small

SHINGLE = 5
SIMILARITY = 0.8

#: 24 bands of 6 registers: texts at a probability Jaccard of 0.8 share a band with a chance of 0.9993, at 0.85 of 0.999998.
BANDS, ROWS = 24, 6

_U = np.uint64


def signatures(hashes: np.ndarray, begins: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash signatures (texts x registers) of the shingles of many texts; a text without shingles has zeros.

    A shingle that occurs w times in a text is a Poisson process of rate w whose arrivals go to random registers; each
    register keeps the shingle of its earliest arrival. A process ends as soon as its next arrival is later than the
    latest earliest arrival of its text's registers. Arrivals are drawn in rounds for all live processes at once.
    """
    texts = len(begins) - 1
    of = np.repeat(np.arange(texts), np.diff(begins))
    order = np.lexsort((hashes, of))
    h, of = hashes[order], of[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(h))).astype(np.float64)
    h, of = h[at], of[at]
    earliest = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    time, step, width = np.zeros(len(h)), 0, 1
    while len(h):
        for _ in range(width):
            step += 1
            r = bytewords.mix(h + _U(0x9E3779B97F4A7C15 * step % (1 << 64)))
            time = time - np.log(((r >> _U(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
            slot = of * registers + (bytewords.mix(r) % _U(registers)).astype(np.int64)
            np.minimum.at(earliest, slot, time)
            won = earliest[slot] == time
            winner[slot[won]] = h[won]
        latest = earliest.reshape(texts, registers).max(1)
        live = time < latest[of]
        h, of, weight, time = h[live], of[live], weight[live], time[live]
        width = min(32, width * 2) if len(h) < 10_000 else 1
    return winner.reshape(texts, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(-1, bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        out = bytewords.mix(out * _U(0xD1342543DE82EF95) + parts[:, :, r])
    return out


def _text_shingles(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, where each text's begin) for runs of rows."""
    for row, _, data, offsets in bytewords.slices(column):
        start, end, begins = bytewords.words(data, offsets)
        hashes = bytewords.hash_spans(bytewords.LOWER[data], start, end)
        found, at = bytewords.shingles(hashes, begins, size)
        yield row, found, at


def _once(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, and where each text's begin."""
    of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((hashes, of))
    h, of = hashes[order], of[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[first], np.concatenate([[0], np.cumsum(np.bincount(of[first], minlength=len(begins) - 1))])


def _sketch(size: int, bands: int, rows: int):
    """Bands of the weighted shingles, and of the distinct ones: texts that differ in repeats only meet by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, found, at in _text_shingles(b.column("text"), size):
                n = len(at) - 1
                both = [band_hashes(signatures(*x, bands * rows), bands, rows) for x in ((found, at), _once(found, at))]
                hashes = np.concatenate(both, axis=1).astype(np.int64)
                has = np.diff(at) > 0
                lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * 2 * bands, 2 * bands, dtype=np.int32), pa.array(hashes.ravel()), mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, n), b.column("node").slice(row, n), lists], ["doc_id", "node", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, found, at in _text_shingles(b.column("text"), size):
                n = len(at) - 1
                sets = [np.unique(found[at[i] : at[i + 1]]).tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([b.column("node").slice(row, n), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(p), len(q)) < least * max(len(p), len(q)):
                    keep.append(False)
                    continue
                s = np.concatenate([p, q])
                s.sort()
                both = int((s[1:] == s[:-1]).sum())
                keep.append(both >= least * (len(p) + len(q) - both))
            kept = b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if kept.num_rows:
                yield kept

    return run


def text_key() -> Column:
    """128 bits that stand for a whole text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _shingle_sets(wanted: DataFrame, nodes: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """node, shingles (sorted hashes) of the wanted text keys. Each text is fetched once, by the smallest doc_id that has it."""
    ids = materialize(wanted.join(nodes.select("node", F.col("rep").alias("doc_id")), "node"), "wanted")
    texts = documents.select("doc_id", F.lower("text").alias("text"), text_key().alias("_quill_key")).join(small(ids.withColumnRenamed("doc_id", "_rep")), F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("_quill_key") == F.col("node")))
    sets = materialize(map_batches(texts.select("node", "text").dropDuplicates(["node"]), _sets(size), "node binary, shingles binary"), "sets")
    discard(ids)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, least: float, name: str) -> DataFrame:
    """The pairs (a, b) of text keys whose sets of shingles have a Jaccard similarity of at least `least`."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return materialize(map_batches(both.select("a", "b", "sa", "sb"), _similar(least), "a binary, b binary"), f"{name}-links")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    often = counts > 1
    column = np.cumsum(often) - 1
    keep = often[at]
    of, column = of[keep], column[at[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for lo in range(0, int(often.sum()), 4096):
        x, y = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[of[x:y], column[x:y] - lo] = 1
        out += m @ m.T
    return out


def _block_links(least: float):
    """Within each task (the members of one or two blocks of a bucket), links enough to connect what the task connects."""

    def links(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        names = {r: i for i, r in enumerate(dict.fromkeys(r[1] for r in rows))}
        label = np.array([names[r[1]] for r in rows])
        size = np.array([len(x) for x in sets])
        both = _shared(sets)
        ok = np.triu(both >= least * (size[:, None] + size[None, :] - both), 1) & (label[:, None] != label[None, :])
        out = []
        for x, y in zip(*np.nonzero(ok), strict=True):
            if label[x] != label[y]:
                label[label == label[y]] = label[x]
                out.append((rows[x][0], rows[y][0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, out = None, [], []
        for b in batches:
            for t, node, root, shingles in zip(*(b.column(c).to_pylist() for c in ("task", "node", "root", "shingles")), strict=True):
                if t != task:
                    out += links(rows)
                    task, rows = t, []
                rows.append((node, root, shingles))
        out += links(rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


#: Members of a mixed bucket up to which its pairs are made as rows (a bounded number for each member); larger buckets are
#: compared block by block, without rows for pairs.
PAIRED, BLOCK = 32, 256


def _across(rooted: DataFrame, stars: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links between members of a bucket (bucket, node, root) that lie in different classes so far."""
    sizes = rooted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    sized = materialize(rooted.join(sizes, "bucket"), "mixed-sized")
    x, y = (sized.where(F.col("n") <= PAIRED).select("bucket", F.col("node").alias(n), F.col("root").alias(f"root_{n}")) for n in "xy")
    pairs = x.join(y, "bucket").where("root_x < root_y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found = _verified(pairs.join(stars, ["a", "b"], "left_anti"), sets, least, "rest")
    large = sized.where(F.col("n") > PAIRED).withColumn("_of", F.ceil(F.col("n") / BLOCK).cast("int"))
    if not large.limit(1).count():
        return found
    large = large.withColumn("_i", F.pmod(F.xxhash64("node", "bucket"), F.col("_of")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_of") - 1))
    tasks = large.select("bucket", "node", "root", "_i", other.alias("_j")).select("node", "root", F.xxhash64("bucket", F.least("_i", "_j"), F.greatest("_i", "_j")).alias("task"))
    tasks = tasks.join(sets, "node").repartition("task").sortWithinPartitions("task", "node")
    more = materialize(map_batches(tasks.select("task", "node", "root", "shingles"), _block_links(least), "a binary, b binary"), "block-links")
    return found.unionByName(more)


def near_duplicates(documents: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, node (key of its text), class_id (the smallest doc_id of its class), kept (doc_id = class_id).

    Two different texts are linked if they share a band and the Jaccard similarity of their sets of `size`-word shingles
    (lower-cased runs of letters and digits; a text of fewer words is one shingle) is at least `least`; classes are the
    connected components, equal texts share a class. Within a band's bucket all texts are first compared with one of
    them; only where texts then still lie in different classes are they compared with each other, in small buckets as
    pairs, in large ones block by block, so that a large group of near copies makes no rows for its pairs and no link
    between classes is lost.
    Texts without any word (null and empty ones too) are linked with nothing and kept. Rows without doc_id take part and
    never lead a class that has an id. Repeated rows get equal results.
    """
    sketched = map_batches(documents.select("doc_id", text_key().alias("node"), F.lower("text").alias("text")), _sketch(size, bands, rows), "doc_id long, node binary, bands array<long>")
    sketched = materialize(sketched, "sketch")
    nodes = materialize(sketched.where("bands is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "nodes")
    members = nodes.select(F.explode(F.array_distinct("bands")).alias("bucket"), "node")
    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("bucket", "hub")
    members = materialize(members.join(hubs, "bucket"), "buckets")
    sets = _shingle_sets(members.select("node").distinct(), nodes, documents, size)
    stars = materialize(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = _verified(stars, sets, least, "stars")
    found = materialize(components(links, "near"), "near")

    rooted = members.join(found, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    more = materialize(_across(materialize(rooted.join(mixed, "bucket"), "mixed"), stars, sets, least), "more")
    if more.limit(1).count():
        found = materialize(components(links.unionByName(more), "near"), "near")
    for x in (members, stars, sets):
        discard(x)

    led = nodes.select("node", "rep").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = led.groupBy("root").agg(F.min("rep").alias("class_id"))
    of = led.join(classes, "root").select("node", "class_id")
    out = sketched.join(of, "node", "left").withColumn("class_id", F.when(F.col("bands").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))
    return out.select("doc_id", "node", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """documents with one row of each class of near copies, all columns as they were; of exactly repeated rows of a kept
    document one remains."""
    classes = materialize(near_duplicates(documents, **options).select("doc_id", "node", "kept"), "classes")
    lost = materialize(classes.where("not kept").select("doc_id", F.col("node").alias("_quill_key")).distinct(), "lost")
    repeated = materialize(classes.where("kept and doc_id is not null").groupBy("doc_id", F.col("node").alias("_quill_key")).count().where("count > 1").drop("count"), "repeated")
    keyed = documents.withColumn("_quill_key", text_key())
    gone = small(lost.select(F.col("doc_id").alias("_quill_lost"), F.col("_quill_key").alias("_quill_lost_key")))
    left = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_quill_lost")) & (F.col("_quill_key") == F.col("_quill_lost_key")), "left_anti")
    if repeated.limit(1).count():
        again = left.join(small(repeated), ["doc_id", "_quill_key"], "left_semi").dropDuplicates(["doc_id", "_quill_key"])
        left = left.join(small(repeated), ["doc_id", "_quill_key"], "left_anti").unionByName(again)
    return left.select(*documents.columns)

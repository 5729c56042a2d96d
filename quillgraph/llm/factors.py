"""Substring deduplication: documents are factored against all earlier ones, and long factors go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import bytewords
from quillgraph.llm.common import map_batches, materialize, small
from quillgraph.llm.minhash import text_key

#: Words of the shortest factor, and of the seeds by which reference blocks are found. Each run of WINDOW words has the same WINDOW
#: - SEED + 1 seeds wherever it stands, and the smallest of them leads to it.
WINDOW, SEED = 13, 6

_LAST = 2**63 - 1  # the place of rows without doc_id, after all others
_SPACE = 32


def _read(column: pa.Array) -> Iterator[tuple]:
    """Per slice of texts: first row, bytes, words (start, end, where each text begins), hashes of words, starts of the windows
    that lie within a text, the row of each of them and its smallest seed."""
    for row, to, data, offsets in bytewords.slices(column):
        start, end, begins = bytewords.words(data, offsets, bytewords.SOLID)
        hashes = bytewords.hash_spans(data, start, end)
        n = len(hashes)
        if n < WINDOW:
            none = np.zeros(0, np.int64)
            yield row, to, data, start, end, begins, hashes, none, none, np.zeros(0, np.uint64)
            continue
        of = np.repeat(np.arange(to - row), np.diff(begins))
        least, _ = bytewords.shingles(hashes, np.array([0, n]), SEED)
        width, need = 1, WINDOW - SEED + 1
        while width < need:  # minima of runs of seeds, doubled in length
            step = min(width, need - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        inside = np.flatnonzero(np.arange(len(least)) + WINDOW <= begins[of[: len(least)] + 1])
        yield row, to, data, start, end, begins, hashes, inside, of[inside] + row, least[inside]


def _window_hashes(hashes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the words of windows."""
    whole = np.array([0, len(hashes)])
    first, _ = bytewords.shingles(hashes, whole, WINDOW)
    second, _ = bytewords.shingles(bytewords.mix(hashes + np.uint64(0x632BE59BD9B4E019)), whole, WINDOW)
    return first[inside].astype(np.int64), (second[inside] >> np.uint64(33)).astype(np.int32)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins, in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _seeds():
    """(known, seed, text): each seed once per batch with the first text that has it. Where several texts of a batch have it, it is
    known to be shared by all of them: those are noted apart, so that a seed that very many have is sent on once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, seeds, owners = b.column("text_id").to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for *_, rows, least in _read(b.column("text")):
                if len(rows):
                    new = _firsts(rows, least)
                    seeds.append(least[new].astype(np.int64))
                    owners.append(texts[rows[new]])
            seed, text = np.concatenate(seeds), np.concatenate(owners)
            order = np.lexsort((text, seed))
            seed, text = seed[order], text[order]
            once = _firsts(seed, text)
            seed, text = seed[once], text[once]
            first = _firsts(seed)
            several = np.diff(np.append(np.flatnonzero(first), len(seed))) > 1
            shared = np.repeat(several, np.diff(np.append(np.flatnonzero(first), len(seed))))
            known = np.r_[np.zeros(first.sum(), bool), np.ones(shared.sum(), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(np.r_[seed[first], seed[shared]]), pa.array(np.r_[text[first], text[shared]])], ["known", "seed", "text_id"])

    return run


def _candidates():
    """(known, hash, check, place, text, source) of the windows with a shared seed: each window once per batch with the first place
    that has it; later places of the batch are known to repeat that one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, places = b.column("text_id").to_numpy(), b.column("place").to_numpy()
            lists = b.column("seeds")
            made = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
            for row, to, *_, hashes, inside, rows, least in _read(b.column("text")):
                if not len(rows):
                    continue
                least, keep = least.astype(np.int64), np.zeros(len(rows), bool)
                edges = np.searchsorted(rows, np.arange(row, to + 1))
                for r in range(row, to):
                    x, y = edges[r - row], edges[r - row + 1]
                    if y > x:
                        keep[x:y] = np.isin(least[x:y], lists[r].values.to_numpy())
                if keep.any():
                    made.append((*_window_hashes(hashes, inside[keep]), rows[keep]))
            h, g, rows = (np.concatenate(x) for x in zip(*made, strict=True))
            place, text = places[rows], texts[rows]
            order = np.lexsort((text, place, g, h))
            h, g, place, text = h[order], g[order], place[order], text[order]
            once = _firsts(h, g, place, text)
            h, g, place, text = h[once], g[once], place[once], text[once]
            first = _firsts(h, g)
            source = np.repeat(place[first], np.diff(np.append(np.flatnonzero(first), len(h)))) if len(h) else place
            later = place > source
            send = first | ~later & ~first  # of one place, every text is sent on
            columns = [np.r_[np.zeros(send.sum(), bool), np.ones(later.sum(), bool)], *(np.r_[c[send], c[later]] for c in (h, g, place, text, source))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["known", "hash", "check", "place", "text_id", "source"])

    return run


def _factored():
    """Factors and kept text of each document: `copied` ones repeat an earlier text as a whole, `hashes` are the windows of the
    others that earlier documents have, with the first of these."""

    def parse(rows: np.ndarray, source: np.ndarray, starts: np.ndarray) -> list[dict]:
        """Greedy factors: as long as each following window is in the same earlier document, the factor grows; where it ends, the
        windows across its end are looked at for the next one."""
        new = _firsts(source, starts - np.arange(len(starts)))
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(starts)))
        return [{"start": int(starts[i]), "length": int(n) + WINDOW - 1, "source": int(source[i])} for i, n in zip(at, length, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copied, lists, sources = b.column("copied").to_pylist(), b.column("hashes"), b.column("sources")
            first_places = b.column("first").to_pylist()
            for row, to, data, start, end, begins, hashes, inside, rows, _ in _read(b.column("text")):
                gone = np.zeros(len(start) + 1, np.int64)
                edges = np.searchsorted(rows, np.arange(row, to + 1))
                factors = [[] for _ in range(row, to)]
                h = None
                for r in range(row, to):
                    i, x, y = r - row, edges[r - row], edges[r - row + 1]
                    if copied[r] and y > x:
                        gone[begins[i]] += 1
                        gone[begins[i + 1]] -= 1
                        factors[i] = [{"start": 0, "length": int(begins[i + 1] - begins[i]), "source": first_places[r]}]
                    elif y > x and lists[r].is_valid:
                        if h is None:
                            h = _window_hashes(hashes, inside)
                        known = lists[r].values
                        name = np.stack([known.field("hash").to_numpy(), known.field("check").to_numpy().astype(np.int64)], 1)
                        order = np.lexsort((name[:, 1], name[:, 0]))
                        name, from_ = name[order], sources[r].values.to_numpy()[order]
                        at = np.searchsorted(name[:, 0], h[0][x:y])
                        at = np.minimum(at, len(name) - 1)
                        while True:  # equal first halves: go on to the equal second one
                            further = (name[at, 0] == h[0][x:y]) & (name[at, 1] < h[1][x:y]) & (at + 1 < len(name))
                            if not further.any():
                                break
                            at = at + further
                        hit = (name[at, 0] == h[0][x:y]) & (name[at, 1] == h[1][x:y])
                        starts = inside[x:y][hit]
                        np.add.at(gone, starts, 1)
                        np.add.at(gone, starts + WINDOW, -1)
                        factors[i] = parse(rows, from_[at[hit]], starts - begins[i])
                keep = np.cumsum(gone)[:-1] <= 0
                of = np.repeat(np.arange(to - row), np.diff(begins))
                last, kept = np.zeros(len(start), bool), np.flatnonzero(keep)
                last[kept[:-1][of[kept][1:] != of[kept][:-1]]] = True
                last[kept[-1:]] = True
                mark = np.zeros(len(data) + 1, np.int8)
                np.add.at(mark, start[kept], 1)
                np.add.at(mark, end[kept], -1)
                shown = np.cumsum(mark)[:-1] > 0
                text, gaps = data.copy(), end[keep & ~last]
                text[gaps], shown[gaps] = _SPACE, True
                size = np.concatenate([[0], np.cumsum(shown)])
                first_byte = size[np.append(start, len(data))[begins[:-1]]]
                stop = np.append(first_byte[1:], size[-1])
                flat = text[shown].tobytes()
                out = [flat[p:q].decode("utf-8") for p, q in zip(first_byte.tolist(), stop.tolist(), strict=True)]
                removed = np.bincount(of[~keep], minlength=to - row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(row, to - row), pa.array(np.diff(begins).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(out, pa.string()), pa.array(factors, _FACTORS)],
                    ["doc_id", "n_words", "n_removed", "kept", "factors"],
                )

    return run


_FACTORS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64())]))
_RESULT = "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start: long, length: long, source: long>>"


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of these text_ids; where the ids are few enough to broadcast, other texts are not shuffled."""
    return rows.join(small(ids), "text_id", "left_semi")


def without_repeated_passages(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and factors (start, length in words
    and source, the smallest doc_id that has it), the parts that earlier documents have.

    Words are what stands between ASCII white space. Each document is factored against all with a smaller doc_id: greedily, a factor
    goes on as long as the same earlier document has the next window of WINDOW words too, and the windows across its end begin the
    next one. All words of factors go. The earlier documents are indexed in blocks, by hash: a run of SEED words that several texts
    have is a seed, and only the windows whose smallest seed is shared are looked up. Equal texts are read as one, at their
    smallest doc_id; the others repeat it as a whole. In each batch equal seeds and windows are sent on once, so that passages which
    very many documents share are not gathered anywhere. Windows count as equal by 96 bits of their words' hashes.

    Documents of under WINDOW words keep all. Rows without doc_id come after all others, and none of them is earlier than another.
    Rows of one doc_id are not earlier than each other; repeated rows get equal results. Null texts are empty; further columns are
    not looked at; an empty table gives none.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.coalesce("doc_id", F.lit(_LAST)))
    keyed = rows.withColumn("text_id", F.xxhash64("text"))
    classes = keyed.select("text_id", text_key().alias("key"), "place").groupBy("text_id", "key").agg(F.min("place").alias("first"), F.max("place").alias("end"))
    classes = materialize(classes, "text-classes")

    seeds = map_batches(keyed.select("text", "text_id"), _seeds(), "known boolean, seed long, text_id long")
    apart = F.when(F.col("known"), F.col("text_id"))
    per = Window.partitionBy("known", "seed", apart)
    seeds = seeds.withColumn("lo", F.min("text_id").over(per)).withColumn("hi", F.max("text_id").over(per)).where("known OR lo < hi")
    lists = materialize(seeds.groupBy("text_id").agg(F.collect_set("seed").alias("seeds")), "seed-lists")
    lists = lists.join(classes.groupBy("text_id").agg(F.min("first").alias("first")), "text_id")

    near = _only(keyed, lists.select("text_id")).join(lists, "text_id").where("place = first")
    windows = map_batches(near.select("text", "text_id", "place", "seeds"), _candidates(), "known boolean, hash long, check int, place long, text_id long, source long")
    per = Window.partitionBy("known", "hash", "check", apart)
    windows = windows.withColumn("source", F.min("source").over(per)).where("source < place")
    found = windows.groupBy("text_id").agg(F.collect_list(F.struct("hash", "check", "source")).alias("_w"))
    found = materialize(found, "repeated-windows")

    repeated = classes.where("first < end").groupBy("text_id").agg(F.min("first").alias("first"))
    info = repeated.withColumn("again", F.lit(True)).join(found, "text_id", "full")
    ids = materialize(info.select("text_id"), "repeated-texts")
    firsts = classes.withColumnRenamed("first", "_first").select("text_id", "key", "_first")
    touched = _only(keyed, ids).join(info.select("text_id", "_w"), "text_id").withColumn("key", text_key()).join(firsts, ["text_id", "key"])
    copied = F.col("place") > F.col("_first")
    touched = touched.select("doc_id", "text", copied.alias("copied"), F.col("_first").alias("first"), F.transform("_w", lambda w: F.struct(w["hash"].alias("hash"), w["check"].alias("check"))).alias("hashes"), F.transform("_w", lambda w: w["source"]).alias("sources"))
    plain = keyed.join(small(ids), "text_id", "left_anti").select("doc_id", "text", F.lit(False).alias("copied"), F.lit(_LAST).alias("first"), F.lit(None).cast("array<struct<hash: long, check: int>>").alias("hashes"), F.lit(None).cast("array<long>").alias("sources"))
    return map_batches(touched, _factored(), _RESULT).unionByName(map_batches(plain, _factored(), _RESULT))


def passage_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of without_repeated_passages, with the same rules for odd rows."""
    return without_repeated_passages(documents).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

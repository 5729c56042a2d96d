"""Near-duplicate embeddings by an exact metric range join over pivot cells."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import components, map_batches, materialize

COSINE = 0.95

#: Vectors that a group of cells is home to: GROUP times the square root of their number, HOME at least, and no more than fit into
#: HOME_BYTES in double precision. A group's memory is bounded by the bytes, its candidates stream past. Where no cell can be ruled
#: out, each vector goes to each group, so there are fewer groups than cells.
HOME, GROUP, HOME_BYTES = 4096, 32, 1 << 24

#: Pivots, and so cells, as a share of the square root of the number of vectors; and most of them. The driver holds them and each
#: task gets them (1 MB for 2,048 vectors of 64 dimensions). Beyond, cells are cut into parts.
CELLS, PIVOTS = 0.5, 2048

_SLACK = 1e-9  # radians, against rounding


def _keyed(kind: str, dim: int):
    dtype = np.dtype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, vecs = [], []
            for x in b.column("embedding"):
                if x is None or not x.is_valid:
                    keys.append(None)
                    vecs.append(None)
                    continue
                v = np.zeros(dim, dtype)
                part = x.values.to_numpy(zero_copy_only=False)
                v[: len(part)] = part
                v += 0.0  # -0.0 becomes 0.0
                raw = v.tobytes()
                keys.append(hashlib.md5(raw).digest())
                vecs.append(raw)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "key", "vec"])

    return run


def _unit(raw: bytes | list, kind: str, dim: int) -> np.ndarray:
    v = np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # against overflow and underflow of the squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1, 1))


def _blob(column: pa.Array) -> bytes:
    return b"".join(column.to_pylist())


def _cells(kind: str, dim: int, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angles = _angles(_unit(_blob(b.column("vec")), kind, dim), pivots)
            home = angles.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(angles[np.arange(len(home)), home])], ["cell", "angle"])

    return run


def _home(n: int, dim: int) -> int:
    """Vectors that a group is home to."""
    return max(1, min(HOME_BYTES // (8 * dim), max(HOME, GROUP * math.isqrt(n))))


def _pivots(n: int) -> int:
    return min(PIVOTS, max(1, math.ceil(CELLS * math.sqrt(n))))


def _groups(counts: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each cell, and how many it has: cells of more than `home` vectors have groups of their own, the others
    share one up to that number."""
    first, parts, group, filled = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for c, n in enumerate(counts.tolist()):
        if n > home:
            group += filled > 0
            first[c], parts[c] = group, -(-n // home)
            group, filled = group + int(parts[c]), 0
            continue
        if filled and filled + n > home:
            group, filled = group + 1, 0
        first[c], filled = group, filled + n
    return first, parts


def _possible(angles: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Which cells may hold a vector within `reach` of these: by the triangle inequality, a cell's pivot is at most twice the reach
    farther than the nearest one, and within the cell's radius plus the reach."""
    return (angles <= angles.min(1, keepdims=True) + 2 * reach + _SLACK) & (angles <= radius[None] + reach + _SLACK)


def _routed(kind: str, dim: int, pivots: np.ndarray, radius: np.ndarray, first: np.ndarray, parts: np.ndarray, reach: float):
    """Blocks of vectors for the groups: homes with their cells (kind 0), and candidates with a bit for each cell of the group that
    the triangle inequality cannot rule out (kind 1)."""
    cells = {g: np.flatnonzero((first <= g) & (g < first + parts)) for g in range(int((first + parts).max()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(_blob(b.column("vec")), np.uint8).reshape(b.num_rows, -1)
            keys = np.frombuffer(_blob(b.column("key")), np.uint8).reshape(b.num_rows, 16)
            counts = b.column("n").to_numpy()
            angles = _angles(_unit(raw.tobytes(), kind, dim), pivots)
            home = angles.argmin(1)
            group = first[home] + keys[:, :4].copy().view(np.uint32).ravel() % parts[home]
            possible = _possible(angles, radius, reach)
            out: list[tuple] = []
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

            def packed() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["group", "kind", "keys", "counts", "vecs", "cells"])
                out.clear()
                return made

            def block(g: int, what: int, rows: np.ndarray, of: np.ndarray) -> None:
                out.append((int(g), what, keys[rows].tobytes(), counts[rows].astype(np.int64).tobytes(), raw[rows].tobytes(), of.tobytes()))

            for g, mine in cells.items():
                own = np.flatnonzero(group == g)
                if len(own):
                    block(g, 0, own, home[own].astype(np.int32))
                may = possible[:, mine]
                near = np.flatnonzero(may.any(1))
                for at in range(0, len(near), 2048):
                    rows = near[at : at + 2048]
                    block(g, 1, rows, np.packbits(may[rows], axis=1))
                if len(out) >= 16:
                    yield packed()
            if out:
                yield packed()

    return run


def _joined(kind: str, dim: int, least: float, first: np.ndarray, parts: np.ndarray):
    """For each home its number of links (b null), and links (a, b) enough to connect what is connected in the group. Each cell of
    the group is compared with the candidates it may hold only."""

    def finish(keys, links, label) -> pa.RecordBatch:
        a = [keys[i] for i in range(len(keys))] + [keys[i] for i in range(len(keys)) if label[i] != i]
        b = [None] * len(keys) + [keys[label[i]] for i in range(len(keys)) if label[i] != i]
        n = (links - 1).astype(np.int64).tolist() + [0] * (len(a) - len(keys))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, homes, waiting = None, [], None, []
        links = label = edge = None
        for b in batches:
            for g, what, ks, ns, vs, cs in zip(*(b.column(c) for c in ("group", "kind", "keys", "counts", "vecs", "cells")), strict=True):
                g, what, ks, vs, cs = g.as_py(), what.as_py(), ks.as_py(), vs.as_py(), cs.as_py()
                if g != group:
                    if homes is not None:
                        yield finish(keys, links, label)
                    group, keys, homes, waiting = g, [], None, []
                names = [ks[i : i + 16] for i in range(0, len(ks), 16)]
                if what == 0:
                    keys += names
                    waiting.append((np.frombuffer(cs, np.int32), _unit(vs, kind, dim)))
                    continue
                if not waiting and homes is None:
                    continue  # a group without homes
                if homes is None:
                    cell, homes = np.concatenate([c for c, _ in waiting]), np.concatenate([v for _, v in waiting])
                    order, waiting = np.argsort(cell, kind="stable"), []
                    cell, homes, keys = cell[order], homes[order], [keys[i] for i in order]
                    links, label = np.zeros(len(keys)), np.arange(len(keys))
                    mine = np.flatnonzero((first <= g) & (g < first + parts))
                    edge = np.stack([np.searchsorted(cell, mine), np.searchsorted(cell, mine, "right")], 1)
                counts, other = np.frombuffer(ns.as_py(), np.int64).astype(np.float64), _unit(vs, kind, dim)
                may = np.unpackbits(np.frombuffer(cs, np.uint8).reshape(len(names), -1), axis=1)[:, : len(edge)].astype(bool)
                met: dict[int, list[np.ndarray]] = {}
                for c, (x, y) in enumerate(edge.tolist()):
                    rows = np.flatnonzero(may[:, c]) if y > x else ()
                    width = max(16, min(512, (1 << 21) // max(y - x, 1)))  # 16 MB of products at once
                    for at in range(0, len(rows), width):
                        some = rows[at : at + width]
                        hit = homes[x:y] @ other[some].T >= least
                        links[x:y] += hit.astype(np.float64) @ counts[some]
                        for j in np.flatnonzero(hit.any(0)):
                            met.setdefault(int(some[j]), []).append(x + np.flatnonzero(hit[:, j]))
                edges = []
                for j, parts_met in met.items():
                    found = np.concatenate(parts_met)
                    if keys[found[0]] != names[j]:
                        edges.append((keys[found[0]], names[j]))
                    if len(found) > 1 and len(old := np.unique(label[found])) > 1:
                        label[np.isin(label, old)] = old[0]
                if edges:
                    a, c = zip(*edges, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(c, pa.binary()), pa.array([0] * len(a), pa.int64())], ["a", "b", "n"])
        if homes is not None:
            yield finish(keys, links, label)

    return run


def near_vectors(embeddings: DataFrame, least: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors at a cosine of at least `least`), component_id (the smallest
    vec_id reachable by links) and kept (vec_id = component_id).

    Vectors are compared as directions, by angle, which is a metric. Each distinct vector is at home in the cell of its
    nearest pivot. It is also a candidate in every cell that may hold a vector within the angle t of the threshold: by the
    triangle inequality, cells whose pivot is at most 2 t farther than its own and within the cell's radius plus t. The number of
    cells grows with the square root of the number of vectors; small cells share a group, to which a candidate goes once. Each
    cell is joined by itself in double precision; it counts links and passes on only as many of them as connect what it
    has connected. Equal vectors are joined once, with their number. Vectors of fewer components count as padded with
    zeros. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Rows without
    vec_id count as links of others and never name a component that has an id. Repeated rows count as links of each other and
    get equal results, further columns are not looked at, and an empty table gives none.
    """
    kind = "f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "f8"
    e = F.col("embedding") if kind == "f4" else F.col("embedding").cast("array<double>")
    limit = float(np.finfo(kind).max)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= limit)) & F.exists(e, lambda x: x != 0)
    rows = embeddings.select("vec_id", F.when(fine, e).alias("embedding"))
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    if dim < 1:
        return rows.select("vec_id", *alone)
    keyed = materialize(map_batches(rows, _keyed(kind, dim), "vec_id long, key binary, vec binary"), "vectors")
    distinct = materialize(keyed.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("lo"), F.first("vec").alias("vec")), "distinct")
    n = distinct.count()
    home = _home(n, dim)
    picked = distinct.orderBy("key").limit(_pivots(n)).select("vec").collect()
    if not picked:
        return rows.select("vec_id", *alone)
    pivots = _unit(b"".join(bytes(r["vec"]) for r in picked), kind, dim)
    radius, counts = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in map_batches(distinct.select("vec"), _cells(kind, dim, pivots), "cell int, angle double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect():
        radius[r["cell"]], counts[r["cell"]] = r["r"], r["n"]
    first, parts = _groups(counts, home)
    blocks = map_batches(distinct.select("key", "n", "vec"), _routed(kind, dim, pivots, radius, first, parts, math.acos(least)), "group long, kind int, keys binary, counts binary, vecs binary, cells binary")
    blocks = blocks.repartition("group").sortWithinPartitions("group", "kind")
    found = materialize(map_batches(blocks, _joined(kind, dim, least, first, parts), "a binary, b binary, n long"), "joined")
    roots = materialize(components(found.where("b is not null").select("a", "b"), "vectors"), "roots")
    led = distinct.select("key", "lo").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = led.groupBy("root").agg(F.min("lo").alias("component_id"))
    of = led.join(named, "root").join(found.where("b is null").select(F.col("a").alias("key"), "n"), "key").select("key", "component_id", "n")
    out = keyed.select("vec_id", "key").join(of, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

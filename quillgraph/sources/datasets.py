"""Writers: snapshot datasets with checked manifests, published by one rename; sorted exports; JSON artifacts."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.scratch import materialize

SCHEMA_VERSION = 3

#: Rows of a file at most: files are hashed whole by one task each, which 2 GB would be too much for.
FILE_ROWS = 20_000_000


class DatasetError(RuntimeError):
    """A dataset is missing, incomplete or not what its manifest says."""


def sha256_file(path: Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def canonical_json(value) -> str:
    """Sorted keys, no spaces, text as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_hash(value, length: int = 16) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:length]


def stable_id(parts: Iterable, length: int = 12) -> str:
    """A digest of parts in the given order, joined by bars."""
    return hashlib.sha256("|".join(str(p) for p in parts).encode()).hexdigest()[:length]


def with_stable_id(df: DataFrame, columns: list[str], name: str, length: int = 12) -> DataFrame:
    """The same digest as a column."""
    return df.withColumn(name, F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256), 1, length))


class Store:
    """A folder on any file system that Spark reads, as the driver sees it: names, sizes, small files and renames only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, jvm = spark, spark.sparkContext._jvm
        self._path, self._jvm, self.root = jvm.org.apache.hadoop.fs.Path, jvm, root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def rename(self, old: str, new: str) -> None:
        """One rename; the new name must not be taken."""
        if self.exists(new) or not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"cannot move {self.root}/{old} to {new}")

    def write_text(self, name: str, text: str) -> None:
        """A whole file or none: written beside its place and renamed, over an older one if there is one."""
        staged, at = f"{name}.{uuid.uuid4().hex}.tmp", self.at(name)
        out = self.fs.create(self.at(staged), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.fs.exists(at):
            self.fs.delete(at, False)
        self.rename(staged, name)

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def drop_checksums(self, name: str) -> None:
        """Delete the checksum files that a local file system keeps beside others: the manifest's digests take their place."""
        if self.fs.getUri().getScheme() == "file":
            found = self.fs.getRawFileSystem().listFiles(self.at(name), True)
            while found.hasNext():
                path = found.next().getPath()
                if path.getName().endswith(".crc"):
                    self.fs.getRawFileSystem().delete(path, False)

    def files(self, name: str = "") -> DataFrame:
        """path (below the folder), bytes and sha256 of its Parquet files. Contents are read and hashed by the tasks, a file each."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.root}/{name}" if name else self.root)
        return found.select(F.regexp_extract("path", r"(table=[^/]+/[^/]+)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_json(value, path: str) -> None:
    """One JSON file, complete or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    staged = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    staged.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    os.replace(staged, target)


def write_dataset(tables: dict[str, DataFrame], root: str, snapshot_date: str, order: dict[str, list[str]] | None = None, overwrite: bool = False, file_rows: int = FILE_ROWS, **facts) -> dict:
    """Writes tables as Parquet (zstd) beside each other under snapshot=<date>, with a manifest of rows, bytes and sha256 of each
    file, and publishes the whole by one rename. Tables with an order are range-partitioned and sorted by it (null last), so
    that the files in sequence are the sorted table. `root` is a folder on any file system that Spark reads; files hold file_rows
    at most, so that one task can hash one. A snapshot that is replaced is moved aside first, and back if the new one cannot
    take its place."""
    if not re.fullmatch(r"\d{4}-?\d{2}-?\d{2}", snapshot_date):
        raise ValueError(f"not a snapshot date: {snapshot_date}")
    spark = next(iter(tables.values())).sparkSession
    store, final, staged = Store(spark, root), f"snapshot={snapshot_date}", f".snapshot={snapshot_date}.{uuid.uuid4().hex}"
    if store.exists(final) and not overwrite:
        raise FileExistsError(f"{root}/{final}")
    rows = {}
    try:
        for name, df in tables.items():
            by = [F.col(c).asc_nulls_last() for c in (order or {}).get(name, [])]
            out = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
            out.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(f"{store.root}/{staged}/table={name}")
            rows[name] = spark.read.schema(df.schema).parquet(f"{store.root}/{staged}/table={name}").count()
        files = [{"table": r["path"].split("/")[0].removeprefix("table="), "path": r["path"], "bytes": r["bytes"], "sha256": r["sha256"]} for r in store.files(staged).orderBy("path").collect()]
        manifest = {"schema_version": SCHEMA_VERSION, "snapshot_date": snapshot_date, "rows": rows, "files": files} | facts
        store.write_text(f"{staged}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
        store.drop_checksums(staged)
        aside = f".snapshot={snapshot_date}.{uuid.uuid4().hex}.old"
        if store.exists(final):
            store.rename(final, aside)
        try:
            store.rename(staged, final)
        except Exception:
            if store.exists(aside):
                store.rename(aside, final)
            raise
        store.delete(aside)
    finally:
        store.delete(staged)
    return manifest


def read_manifest(spark: SparkSession, root: str) -> dict:
    store = Store(spark, root)
    if not store.exists("manifest.json"):
        raise DatasetError(f"{root} has no manifest")
    return json.loads(store.read_text("manifest.json"))


def verify_dataset(spark: SparkSession, root: str) -> DataFrame:
    """Files that are missing, changed or not in the manifest (path, problem); contents are hashed by the tasks."""
    manifest = read_manifest(spark, root)
    said = spark.createDataFrame([(f["path"], f["bytes"], f["sha256"]) for f in manifest["files"]], "path string, bytes long, sha256 string")
    found = Store(spark, root).files().withColumnsRenamed({"bytes": "_bytes", "sha256": "_sha"})
    problem = F.when(F.col("_bytes").isNull(), "missing").when(F.col("bytes").isNull(), "not in the manifest").when(F.col("bytes") != F.col("_bytes"), "size").when(F.col("sha256") != F.col("_sha"), "sha256")
    return said.join(found, "path", "full_outer").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def migrate_dataset(spark: SparkSession, root: str, out: str, name: str, table: DataFrame, read: Callable[[SparkSession, str, str], DataFrame]) -> dict:
    """A copy of a dataset with one table added or replaced."""
    old = read_manifest(spark, root)
    tables = {t: read(spark, root, t) for t in old["rows"] if t != name}
    return write_dataset(tables | {name: table}, out, old["snapshot_date"], migrated_from=content_hash(old))


def export_graph(edges: DataFrame, names: DataFrame, root: str, snapshot_date: str) -> dict:
    """Artists and undirected edges as a sorted dataset."""
    undirected = edges.where("artist_a_id < artist_b_id").select("artist_a_id", "artist_b_id", "release_id")
    ids = edges.select(F.col("artist_a_id").alias("artist_id")).distinct()
    return write_dataset({"artists": ids.join(names, "artist_id", "left"), "edges": undirected}, root, snapshot_date, {"artists": ["artist_id"], "edges": ["artist_a_id", "artist_b_id"]}, kind="graph")


def resume_report(spark: SparkSession, root: str) -> dict:
    """Which part files of an unfinished ingest are readable, and after which one to resume."""
    good, bad = [], []
    for p in sorted(Path(root).rglob("*.parquet")):
        try:
            spark.read.parquet(f"file://{p}").limit(1).count()
            good.append(str(p))
        except Exception as e:  # noqa: BLE001  what Spark raises for a broken file depends on the break
            bad.append((str(p), type(e).__name__))
    return {"valid": len(good), "corrupt": bad, "resume_after": good[-1] if good and not bad else None}


def artifact_diff(old, new, at: str = "$") -> list[tuple[str, str]]:
    """Paths at which two JSON values differ, with the kind of difference."""
    if type(old) is not type(new):
        return [(at, "type")]
    if isinstance(old, dict):
        out = [(f"{at}.{k}", "removed") for k in sorted(old.keys() - new.keys())] + [(f"{at}.{k}", "added") for k in sorted(new.keys() - old.keys())]
        return out + [d for k in sorted(old.keys() & new.keys()) for d in artifact_diff(old[k], new[k], f"{at}.{k}")]
    if isinstance(old, list):
        out = [(at, f"length {len(old)} -> {len(new)}")] if len(old) != len(new) else []
        return out + [d for i, (a, b) in enumerate(zip(old, new)) for d in artifact_diff(a, b, f"{at}[{i}]")]
    return [] if old == new else [(at, "value")]


def artifact_rows(artifacts: DataFrame, column: str = "artifact") -> DataFrame:
    """The values of JSON artifacts (one text a row, or a variant) by path: the other columns, path, kind (type) and value (text; null
    for objects and arrays). Each level of nesting is one explosion of all rows that are open, so a large artifact is not read
    by one task alone, and none by the driver."""
    keep = [c for c in artifacts.columns if c != column]
    text = dict(artifacts.dtypes)[column] == "string"
    level = materialize(artifacts.select(*keep, F.lit("$").alias("path"), (F.parse_json(column) if text else F.col(column)).alias("_v")), "artifact")
    out = None
    while True:
        kind = F.regexp_extract(F.schema_of_variant("_v"), r"^[A-Z]+", 0)
        typed = level.withColumn("kind", F.when(F.col("_v").isNull() | (kind == "VOID"), "null").when(kind == "OBJECT", "object").when(kind == "ARRAY", "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "integer").otherwise("fraction"))
        nested = F.col("kind").isin("object", "array")
        rows = typed.select(*keep, "path", "kind", F.when(~nested, F.try_variant_get("_v", "$", "string")).alias("value"))
        out = rows if out is None else out.unionByName(rows)
        open_ = typed.where(nested)
        name = F.when(F.col("_of") == "object", F.concat("path", F.lit("."), "key")).otherwise(F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        inner = open_.withColumnRenamed("kind", "_of").lateralJoin(open_.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        level = materialize(inner.select(*keep, name.alias("path"), F.col("value").alias("_v")), "artifact")
        if not level.limit(1).count():
            return out


def artifact_changes(old: DataFrame, new: DataFrame, column: str = "artifact") -> DataFrame:
    """Paths at which two artifacts (one-row frames) differ, with the kind of difference, as artifact_diff finds them: type, value,
    removed, added, or the lengths of arrays. Below a path that is there on one side only, or of another type, nothing is listed."""
    sides = []
    for df in (old, new):
        rows = materialize(artifact_rows(df.select(column), column), "artifact-rows")
        sizes = rows.where(F.col("path").endswith("]")).groupBy(F.regexp_extract("path", r"^(.*)\[[0-9]+\]$", 1).alias("path")).agg(F.count(F.lit(1)).alias("size"))
        sides.append(rows.join(sizes, "path", "left").withColumn("size", F.coalesce("size", F.lit(0))))
    o, n = (x.select("path", *[F.col(c).alias(f"{c}_{k}") for c in ("kind", "value", "size")]) for x, k in zip(sides, "on", strict=True))
    both = o.join(n, "path", "full_outer")
    arrays = (F.col("kind_o") == "array") & (F.col("kind_n") == "array") & (F.col("size_o") != F.col("size_n"))
    change = F.when(F.col("kind_o").isNull(), "added").when(F.col("kind_n").isNull(), "removed").when(F.col("kind_o") != F.col("kind_n"), "type")
    change = change.when(arrays, F.concat(F.lit("length "), F.col("size_o").cast("string"), F.lit(" -> "), F.col("size_n").cast("string"))).when(~F.col("value_o").eqNullSafe(F.col("value_n")), "value")
    found = materialize(both.select("path", change.alias("change")).where("change IS NOT NULL"), "artifact-changes")
    # what lies under a path that is new, gone or of another type goes with it, and places beyond the end of an array with its length
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.length("path") - 1, F.lit(1))), lambda i: F.when(F.substring("path", i + 1, F.lit(1)).isin(".", "["), F.substring(F.col("path"), F.lit(1), i)))
    under = found.select("path", F.explode(F.array_compact(above)).alias("_up")).join(found.where("change IN ('added', 'removed', 'type')").select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()
    beyond = F.col("path").endswith("]") & F.col("change").isin("added", "removed")
    return found.where(~beyond).join(under, "path", "left_anti")


def artifact_report(old: dict, new: dict) -> dict:
    """What changed between two artifacts: whether they are identical, the fields of versions that differ, and all differences."""
    if content_hash(old) == content_hash(new):
        return {"identical": True, "versions": {}, "differences": []}
    named = sorted(k for k in old.keys() | new.keys() if k.endswith("_version"))
    versions = {k: (old.get(k), new.get(k)) for k in named if old.get(k) != new.get(k)}
    return {"identical": False, "versions": versions, "differences": artifact_diff(old, new)}


def dump_manifest(snapshot: str, base: str, kinds: tuple[str, ...] = ("artists", "labels", "masters", "releases")) -> list[dict]:
    """Where the dumps of a snapshot (YYYYMMDD) lie: kind, file name and address under the base."""
    if not re.fullmatch(r"\d{8}", snapshot):
        raise ValueError(f"not a snapshot: {snapshot}")
    # fixed values: the publisher's file names
    names = {k: f"discogs_{snapshot}_{k}.xml.gz" for k in kinds}
    return [{"kind": k, "file": n, "url": f"{base.rstrip('/')}/{snapshot[:4]}/{n}"} for k, n in names.items()]


def publish_run(staged: str, completed: str) -> list[dict]:
    """Moves a finished run into place by one rename and describes its files; a run that is there already is never replaced."""
    final = Path(completed)
    if final.exists():
        raise FileExistsError(final)
    final.parent.mkdir(parents=True, exist_ok=True)
    os.replace(staged, final)
    return [{"path": str(p.relative_to(final)), "bytes": p.stat().st_size, "sha256": sha256_file(p)} for p in sorted(final.rglob("*")) if p.is_file()]

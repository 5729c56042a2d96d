"""Valid-time enrichment of sales: a stateful stream joins each sale to the version of its client that was valid when it was sold."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.sources.scratch import scratch_root

#: Batches the tables are cut into, the first day (since 1970) and the number of days they cover.
BATCHES, FIRST_DAY, DAYS = 12, 19723, 152

#: Days a change may come after it became valid: 0 to DELAYS - 1.
DELAYS = 4

#: Length of a slice of time in ms. What a client sold and became within a slice lies together; clients are split into slices, so
#: that a client with a third of all rows is no more work for one task than others.
SLICE = 6 * 3_600_000

#: Rows of both tables for each partition of the stream's state, and groups of state in a partition.
ROWS, GROUPS = 500_000, 4

#: Keys that sales without a time are dealt to, within a client.
SALT = 64

SALE, CHANGE, BEAT, CLOSE = range(4)
LATE, SOLD, DIGEST = range(3)

_NONE = -(2**63)
_INPUT = "kind int, late boolean, client long, slice long, ts long, id long, cents long, op string"
_WAITING = pa.schema([("client", pa.int64()), ("slice", pa.int64()), ("ts", pa.int64()), ("id", pa.int64())])
_VERSIONS = pa.schema([*_WAITING, ("cents", pa.int64()), ("op", pa.string())])
_OUTPUT = "rec int, id long, client long, slice long, ts long, fresh long, above long, v_ts long, v_id long, v_cents long, v_op string, t_ts long, t_id long, t_cents long, t_op string"


def _ms(col: str, kind: str) -> Column:
    """Whole milliseconds since 1970, of timestamps with or without a zone (read as UTC)."""
    if kind == "timestamp":
        return F.unix_millis(F.col(col))
    at = F.col(col)  # field by field, so that the session's zone plays no part
    seconds = F.hour(at) * 3600 + F.minute(at) * 60 + F.extract(F.lit("SECOND"), at)
    return (F.date_diff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000 + F.floor(seconds * 1000)).cast("long")


def _batch(day: Column, batches: int) -> Column:
    """The batch of a day since 1970; rows without a day come in the last one, earlier days in the first."""
    cut = F.floor((day - FIRST_DAY) * batches / DAYS)
    return F.greatest(F.least(F.lit(batches - 1).cast("long"), cut), F.lit(0).cast("long"))


def _cents(balance: str) -> Column:
    return F.expr(f"try_cast(floor(100 * {balance} + 0.5D) AS bigint)")


def _split(sales: DataFrame, changes: DataFrame, batches: int, slice_ms: int) -> tuple[DataFrame, DataFrame]:
    """Both tables as rows of the stream's schema, with their batch."""
    kinds = dict(sales.dtypes) | {f"change_{k}": v for k, v in changes.dtypes}
    client = F.coalesce(F.col("client_id"), F.lit(_NONE)).cast("long")
    day = F.floor(_ms("arrived_at", kinds["arrived_at"]) / 86_400_000)
    sold = sales.select("sale_id", client.alias("client"), _ms("sold_at", kinds["sold_at"]).alias("ts"), _batch(day, batches).alias("batch"))
    timeless = -1 - F.pmod(F.xxhash64("sale_id"), F.lit(SALT))
    at = F.when(F.col("ts").isNull() | (F.col("client") == _NONE), timeless).otherwise(F.floor(F.col("ts") / slice_ms))
    sold = sold.select(
        "batch", F.lit(SALE).alias("kind"), F.lit(False).alias("late"), "client", at.cast("long").alias("slice"), F.coalesce("ts", F.lit(_NONE)).alias("ts"),
        F.col("sale_id").cast("long").alias("id"), F.lit(_NONE).alias("cents"), F.lit(None).cast("string").alias("op"),
    )
    became = changes.distinct().where("valid_at IS NOT NULL").select("change_id", client.alias("client"), _ms("valid_at", kinds["change_valid_at"]).alias("ts"), _cents("balance").alias("cents"), "op")
    delay = F.pmod(F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit(""))), F.lit(DELAYS))
    became = became.select(
        _batch(F.floor(F.col("ts") / 86_400_000) + delay, batches).alias("batch"), F.lit(CHANGE).alias("kind"), F.lit(False).alias("late"), "client", F.floor(F.col("ts") / slice_ms).cast("long").alias("slice"), "ts",
        F.col("change_id").cast("long").alias("id"), F.coalesce("cents", F.lit(_NONE)).alias("cents"), "op",
    )
    return sold, became


def _marks(rows: DataFrame, batches: int) -> list[int]:
    """The largest time of each batch and all earlier ones, in ms (0: none yet). One number a batch comes to the driver."""
    top = {r["batch"]: r["ts"] for r in rows.where(F.col("ts") != _NONE).groupBy("batch").agg(F.max("ts").alias("ts")).collect()}
    out = []
    for b in range(batches):
        out.append(max(top.get(b, 0), out[-1] if out else 0, 0))
    return out


def _stage(rows: DataFrame, marks: list[int], groups: int, path: str) -> None:
    """Write a table's batches to folders. Each batch, even an empty one, has a beat whose event time is the mark of its batch; the
    other rows have no event time, so that the watermark never drops them. Changes below the mark of the earlier batches are
    late. After the last batch come rows that close each group."""
    spark = rows.sparkSession
    earlier = F.array(*[F.lit(m).cast("long") for m in [0, *marks[:-1]]])
    before = F.get(earlier, F.col("batch").cast("int"))
    rows = rows.withColumn("late", (F.col("kind") == CHANGE) & (before > 0) & (F.col("ts") < before))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("client", "slice"), F.lit(groups)).cast("int"))
    extra = [(b, BEAT, 0) for b in range(len(marks))] + [(len(marks), CLOSE, g) for g in range(groups)]
    extra = spark.createDataFrame(extra, "batch long, kind int, bucket int").select(
        "batch", "kind", F.lit(False).alias("late"), F.lit(_NONE).alias("client"), F.lit(0).cast("long").alias("slice"), F.lit(_NONE).alias("ts"), F.lit(0).cast("long").alias("id"), F.lit(_NONE).alias("cents"),
        F.lit(None).cast("string").alias("op"), "bucket",
    )
    mark = F.get(F.array(*[F.lit(m).cast("long") for m in marks]), F.col("batch").cast("int"))
    rows.unionByName(extra.coalesce(1)).withColumn("mark", F.when(F.col("kind") == BEAT, F.timestamp_millis(mark))).write.option("compression", "zstd").partitionBy("batch").parquet(path)


def _frame(blob: bytes, schema: pa.Schema) -> pd.DataFrame:
    table = pa.ipc.open_stream(blob).read_all() if blob else schema.empty_table()
    return table.to_pandas()


def _blob(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    table = pa.Table.from_pandas(frame[schema.names], schema=schema, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _last_until(sales: pd.DataFrame, versions: pd.DataFrame) -> np.ndarray:
    """For each sale the row of the last version (both sorted) of its client and slice that was valid by then, or -1."""
    n = len(versions)
    if not len(sales) or not n:
        return np.full(len(sales), -1)
    both = {c: np.concatenate([versions[c].to_numpy(), sales[c].to_numpy()]) for c in ("client", "slice", "ts")}
    is_sale = np.r_[np.zeros(n, np.int8), np.ones(len(sales), np.int8)]
    order = np.lexsort((np.r_[np.arange(n), np.arange(len(sales))], is_sale, both["ts"], both["slice"], both["client"]))
    row = np.where(order < n, order, -1)
    seen = np.maximum.accumulate(np.where(row >= 0, np.arange(len(order)), -1))
    found = np.where(seen >= 0, row[np.maximum(seen, 0)], -1)
    of = order[is_sale[order] == 1] - n
    out = np.full(len(sales), -1)
    out[of] = found[is_sale[order] == 1]
    same = (out >= 0) & (versions["client"].to_numpy()[out] == sales["client"].to_numpy()) & (versions["slice"].to_numpy()[out] == sales["slice"].to_numpy())
    return np.where(same, out, -1)


def _digests(versions: pd.DataFrame, h: int) -> pd.DataFrame:
    """Of each client and slice of these versions (sorted): how many are new and above h, the last one up to h and the last one above."""
    key = versions[["client", "slice"]].to_numpy()
    first = np.r_[True, (key[1:] != key[:-1]).any(1)]
    starts = np.flatnonzero(first)
    ends = np.r_[starts[1:], len(versions)]
    above = versions["ts"].to_numpy() > h
    n_above = np.add.reduceat(above.astype(np.int64), starts)
    base = ends - n_above - 1  # versions are sorted by time, so those above h are the last ones
    out = pd.DataFrame({"client": key[starts, 0], "slice": key[starts, 1], "fresh": np.add.reduceat(versions["new"].to_numpy().astype(np.int64), starts), "above": n_above})
    for name, at, has in (("v", base, base >= starts), ("t", ends - 1, n_above > 0)):
        picked = versions.iloc[np.where(has, at, 0)]
        for c in ("ts", "id", "cents", "op"):
            out[f"{name}_{c}"] = np.where(has, picked[c].to_numpy(), None if c == "op" else _NONE)
    return out


def _keeper(slice_ms: int):
    """What a group of clients' slices does in one batch: note late changes, take the others as versions, emit the sales that H has
    passed with the last version of their own slice, and prune. It is called with new rows, or by its timer."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        h = state.getCurrentWatermarkMs()
        waiting, versions, was = state.get if state.exists else (b"", b"", _NONE)
        waiting, versions = _frame(waiting, _WAITING), _frame(versions, _VERSIONS).assign(new=False)
        new = None if state.hasTimedOut else pd.concat(list(frames), ignore_index=True)
        h = h if h > 0 else _NONE  # no table has got a mark yet
        closing, out = False, []
        if new is not None:
            closing = bool((new["kind"] == CLOSE).any())
            late = new[new["late"]]
            if len(late):
                out.append(pd.DataFrame({"rec": LATE, "id": late["id"].to_numpy()}))
            came = new[(new["kind"] == CHANGE) & ~new["late"] & (new["client"] != _NONE)]
            if len(came):
                versions = pd.concat([versions, came[_VERSIONS.names].assign(new=True)], ignore_index=True)
            waiting = pd.concat([waiting, new.loc[new["kind"] == SALE, _WAITING.names]], ignore_index=True)
        versions = versions.sort_values(["client", "slice", "ts", "id", "cents", "op"], kind="stable", ignore_index=True, na_position="first")
        ready = np.ones(len(waiting), bool) if closing else (waiting["ts"] < h).to_numpy() | (waiting["ts"] == _NONE).to_numpy()
        if ready.any():
            sold = waiting[ready].reset_index(drop=True)
            at = _last_until(sold, versions)
            got = pd.DataFrame({"rec": SOLD, "id": sold["id"], "client": sold["client"], "slice": sold["slice"], "ts": sold["ts"]})
            if len(versions):
                for c in ("ts", "id", "cents", "op"):
                    got[f"v_{c}"] = np.where(at >= 0, versions[c].to_numpy()[at], None if c == "op" else _NONE)
            out.append(got)
            waiting = waiting[~ready]
        if len(versions) and not closing:
            stamp = versions["ts"].to_numpy()
            passed = (stamp <= h) & (stamp > was)  # timers of these ran out
            touched = versions["new"].to_numpy() | passed
            if touched.any():
                name = pd.MultiIndex.from_frame(versions[["client", "slice"]])
                changed = versions[name.isin(name[touched].unique())]
                out.append(_digests(changed.reset_index(drop=True), h).assign(rec=DIGEST))
            # up to h only the last version of a slice stays, and none of slices that h has passed as a whole: those are in the digests
            over = stamp > h
            follows = np.r_[(versions[["client", "slice"]].to_numpy()[1:] == versions[["client", "slice"]].to_numpy()[:-1]).all(1), False]
            last = ~over & ~(follows & np.r_[~over[1:], False]) & ((versions["slice"].to_numpy() + 1) * slice_ms > h)
            versions = versions[over | last]
        if closing:
            state.remove()
        else:
            state.update((_blob(waiting, _WAITING), _blob(versions, _VERSIONS), h))
            # a sale is due once H is beyond it, a version once H has reached it
            due = [int(waiting["ts"].min())] if len(waiting) else []
            ahead = versions["ts"][versions["ts"] > h]
            due += [int(ahead.min()) - 1] if len(ahead) else []
            if due:
                state.setTimeoutTimestamp(max(min(due), state.getCurrentWatermarkMs(), 1))
        for part in out:
            full = pd.DataFrame({c.split()[0]: part[c.split()[0]] if c.split()[0] in part else (None if c.endswith("string") else _NONE) for c in _OUTPUT.split(", ")}, index=part.index)
            yield full

    return run


def _feed(session: SparkSession, root: str, batch: int, slice_ms: int) -> None:
    """Move a batch to the folders that the stream reads, start the stream anew on its checkpoint until it has read it, and delete
    the batch, which is in the state then."""
    path = session.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
    streams = []
    for table in ("sales", "changes"):
        fs.mkdirs(path(f"{root}/{table}"))
        if fs.exists(path(f"{root}/staged-{table}/batch={batch}")) and not fs.rename(path(f"{root}/staged-{table}/batch={batch}"), path(f"{root}/{table}/{batch:03d}")):
            raise OSError(f"cannot move batch {batch} of {table}")
        read = session.readStream.schema(f"{_INPUT}, bucket int, mark timestamp").option("recursiveFileLookup", "true").parquet(f"{root}/{table}")
        streams.append(read.withWatermark("mark", "0 seconds"))
    rows = streams[0].unionByName(streams[1])
    kept = rows.groupBy("bucket").applyInPandasWithState(_keeper(slice_ms), _OUTPUT, "waiting binary, versions binary, was long", "append", "EventTimeTimeout")
    sink = kept.withColumn("batch", F.lit(batch).cast("long")).writeStream.format("parquet").option("compression", "zstd").option("path", f"{root}/emitted").option("checkpointLocation", f"{root}/checkpoint").partitionBy("batch")
    query = sink.trigger(availableNow=True).start()
    query.awaitTermination()
    for table in ("sales", "changes"):
        fs.delete(path(f"{root}/{table}/{batch:03d}"), True)


def _version(prefix: str) -> Column:
    """The columns of a version as one value in order of (valid_at, change_id), or null."""
    cents = F.nullif(F.col(f"{prefix}_cents"), F.lit(_NONE))
    value = F.struct(F.col(f"{prefix}_ts").alias("ts"), F.col(f"{prefix}_id").alias("id"), cents.alias("cents"), F.col(f"{prefix}_op").alias("op"))
    return F.when(F.col(f"{prefix}_ts") != _NONE, value)


def _spine(before: DataFrame | None, digests: DataFrame) -> DataFrame:
    """What each client holds after a batch, slice by slice: versions above H with the last of them, and the one version up to H that
    is not pruned. A client has at most as many rows as slices of time that are not past."""
    now = digests.select("client", "slice", "above", _version("v").alias("base"), _version("t").alias("top"), F.lit(1).alias("age"))
    if before is not None:
        now = now.unionByName(before.withColumn("age", F.lit(0)))
    now = now.repartition("client").groupBy("client", "slice").agg(F.max_by(F.struct("above", "top"), "age").alias("now"), F.max("base").alias("base"))
    last = F.max("base").over(Window.partitionBy("client"))
    now = now.withColumn("base", F.when(F.col("base") == last, F.col("base")))
    return now.select("client", "slice", "now.above", "base", "now.top").where("above > 0 OR base IS NOT NULL")


def enrich_sales(sales: DataFrame, changes: DataFrame, batches: int = BATCHES, slice_ms: int = SLICE, rows_per_partition: int = ROWS) -> DataFrame:
    """Each sale with the version of its client that was valid when it was sold, and each change that came too late: rec (`sale`
    or `late`), id, batch (of emission or lateness), n_held (versions that its client held then), change_id, balance_cents and op.

    Both tables are cut into batches and fed in order to a streaming query that is started anew for each, on one checkpoint in a
    new folder. Each table has a watermark of its own (its largest time of earlier batches, which one row a batch carries, so
    that no row is dropped); H is the smaller one. The query keeps sales and versions in groups of (client, slice of time).
    Event-time timers release the sales that H has passed, in each group with the last version of their own slice, and prune: up to H
    the last version of a slice stays, and none of a slice that is wholly past. What groups hand on for each slice (how many versions,
    the last one up to H, the last one above) makes a table by client, the spine, in which all but the client's last version up to H
    are pruned. A sale takes the latest of: the version of its own slice, the last one of earlier slices, and the client's last one
    up to H; versions before that one are pruned ones.

    So neither a client's rows nor all rows meet in one task. Times count in whole milliseconds. Sales without sold_at are emitted
    at once without a version; rows without client_id have no versions, and late changes without one are reported too; sales without
    arrived_at come in the last batch, changes without valid_at are left out. Repeated sales are separate ones, repeated changes one.
    Ties of valid_at and change_id are ordered by balance, then op. Further columns take no part but for telling changes apart.
    Empty tables give no rows.
    """
    spark = sales.sparkSession
    session = spark.newSession()
    root = f"{scratch_root(spark)}/enriched-{uuid.uuid4().hex}"
    sold, became = _split(sales, changes, batches, slice_ms)
    partitions = max(4, -(-(sales.count() + changes.count()) // rows_per_partition))
    for k, v in {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.streaming.minBatchesToRetain": "2"}.items():
        session.conf.set(k, v)
    for table, rows in (("sales", sold), ("changes", became)):
        _stage(rows, _marks(rows, batches), partitions * GROUPS, f"{root}/staged-{table}")
    spine = None
    for batch in range(batches):
        _feed(session, root, batch, slice_ms)
        digests = spark.read.schema(f"{_OUTPUT}, batch long").parquet(f"{root}/emitted").where(f"batch = {batch} AND rec = {DIGEST}")
        _spine(spine, digests).coalesce(partitions).write.option("compression", "zstd").parquet(f"{root}/spine/batch={batch + 1}")
        spine = spark.read.parquet(f"{root}/spine/batch={batch + 1}")
    _feed(session, root, batches, slice_ms)

    emitted = spark.read.schema(f"{_OUTPUT}, batch long").parquet(f"{root}/emitted")
    sold = emitted.where(f"rec = {SOLD}")
    # what a client holds at a batch, at each slice in which one of its sales is emitted
    held = spark.read.parquet(f"{root}/spine").select(F.col("batch").cast("long").alias("batch"), "client", "slice", "above", "base", "top", F.lit(1).alias("turn"))
    fresh = emitted.where(f"rec = {DIGEST}").select("batch", "client", "slice", F.col("fresh").alias("above"), F.lit(1).alias("turn"))
    asked = sold.select("batch", "client", "slice").distinct().withColumn("turn", F.lit(0))
    every = asked.unionByName(held, allowMissingColumns=True).unionByName(fresh, allowMissingColumns=True)
    whole = Window.partitionBy("batch", "client")
    earlier = whole.orderBy("slice", "turn").rowsBetween(Window.unboundedPreceding, -1)
    at = every.select(
        "batch", "client", "slice", "turn", F.max("base").over(whole).alias("base"), F.max("top").over(earlier).alias("carried"),
        (F.coalesce(F.sum("above").over(whole), F.lit(0)) + F.count("base").over(whole)).alias("n_held"),
    ).where("turn = 0").drop("turn")
    found = sold.join(at, ["batch", "client", "slice"], "left")
    found = found.withColumn("own", _version("v")).withColumn("last", F.greatest("own", "carried", F.when(F.col("base.ts") <= F.col("ts"), F.col("base"))))
    last = F.when(F.col("base").isNull() | (F.col("last") >= F.col("base")), F.col("last"))
    done = found.select(F.lit("sale").alias("rec"), "id", "batch", F.coalesce("n_held", F.lit(0)).cast("long").alias("n_held"), last.alias("_v"))
    done = done.select("rec", "id", "batch", "n_held", F.col("_v.id").alias("change_id"), F.col("_v.cents").alias("balance_cents"), F.col("_v.op").alias("op"))
    late = emitted.where(f"rec = {LATE}").select(F.lit("late").alias("rec"), "id", "batch", *[F.lit(None).cast(t).alias(c) for c, t in (("n_held", "long"), ("change_id", "long"), ("balance_cents", "long"), ("op", "string"))])
    return done.unionByName(late)

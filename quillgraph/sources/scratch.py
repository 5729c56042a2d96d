"""Durable intermediates: frames written once to the shared folder and read back, so that iterative plans stay short and
lost executors cost no recomputation of what came before."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Lets Spark delete a query's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or an own folder where that is unset and all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = os.environ.get("_QUILLGRAPH_SCRATCH") or tempfile.mkdtemp(prefix="quillgraph-")
        os.environ["_QUILLGRAPH_SCRATCH"] = root
        root = f"file://{root}"
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = scratch_root(spark)
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split("://")[-1].strip("/") + "/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

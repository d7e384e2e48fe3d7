"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SCRATCH = "hirelake.scratch.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(name: str = "hirelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table under the cluster's shared `spark.checkpoint.dir`.

    Only a local session may leave that setting out: its executors run in the driver's process, so one local
    folder serves them all. On any other master a folder of one machine would lose rows, so this raises.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and is_local(spark.conf.get("spark.master", "")):
        shared = spark.conf.get(LOCAL_SCRATCH, None)
        if shared is None:
            shared = tempfile.mkdtemp(prefix="hirelake-")
            spark.conf.set(LOCAL_SCRATCH, shared)
    if shared is None:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def is_local(master: str) -> bool:
    """Whether a master runs everything in one process (`local-cluster` does not)."""
    return master == "local" or master.startswith("local[")


def cut_lineage(df: DataFrame, compression: str | None = None, tidy: bool = False) -> DataFrame:
    """`df` written as a table in the shared folder and read back.

    The result survives the loss of executors, is computed once however often it is read, and
    carries its size, so Spark can decide whether to broadcast it. `compression` names another
    Parquet codec than the session's. Under `tidy` the shuffle files of the write are dropped at
    its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    if tidy:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if tidy:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)

"""Session construction, the shared work folder and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default ceiling for an explicit broadcast hint: 64 MiB of estimated plan size.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024

# Streaming state (dedup ids) lives in RocksDB on executor disk, not on the JVM heap.
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings for a large cluster (100 TB inputs). AQE starts from many shuffle
# partitions and coalesces them to ~256 MiB; skewed partitions are split.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
}


def build_session(master: str = "local[8]", partitions: int = 8, app: str = "changeflow") -> SparkSession:
    """A session configured the way the library expects (AQE on, UTC, no UI)."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_session(app: str = "changeflow", conf: dict | None = None) -> SparkSession:
    """A session for a cluster: the master comes from spark-submit, settings from
    ``CLUSTER_CONF`` (plus ``conf`` overrides). ``spark.checkpoint.dir`` must be
    configured by the cluster; it names the shared folder for checkpoints."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**CLUSTER_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is always used as is.
    Only when it is unset on a local master (tests, smoke sessions) a folder of
    our own is created and registered, so later calls agree on one place; any
    other master without the setting is an error, because executors would not
    see a folder of the driver's.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        _ensure_sc_checkpoint(spark, conf_dir)
        return conf_dir.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="changeflow-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def _ensure_sc_checkpoint(spark: SparkSession, path: str) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint root for one job's output."""
    root = checkpoint_root(spark)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", ""), exist_ok=True)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: computed once, safe to re-read."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (an upper bound for scans)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def broadcast_if_bounded(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the plan's size estimate is under ``max_bytes``.

    Otherwise the frame is returned untouched and the join stays a shuffle join
    (AQE may still switch it at run time from the measured shuffle size).
    """
    try:
        size = estimated_bytes(df)
    except Exception:  # no JVM handle (Spark Connect): leave the choice to AQE
        return df
    return F.broadcast(df) if size <= max_bytes else df

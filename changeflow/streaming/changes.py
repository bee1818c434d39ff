"""Structured Streaming forms: change feeds, replay into tables, deduplication.

* ``read_changes`` / ``table_stream``: a file-backed change stream (SRC-5).
  The same frames come from ``format("kafka")`` when that jar is present.
* ``apply_stream``: DER-1 in ``foreachBatch``, merge-on-read: each
  micro-batch's last events are written under its run and batch id (a replayed batch
  overwrites its own folder, so replays are harmless); readers fold base +
  log with ``apply_changes``; ``compact`` publishes a new base.
* ``dedup_stream``: DER-4, at-least-once input made unique per event id.
* ``run_available``: run a stream to completion with ``availableNow`` and read
  its settled output back (checkpoint = the stream position, CAP-11).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.operators.capture import last_events
from changeflow.operators.mutate import apply_changes
from changeflow.schemas import conform, evolve
from changeflow.sinks.tables import current_version, load_all, read_current, read_text, write_text
from changeflow.sources.tables import table_path

FLUSH_INTERVAL = "10 seconds"  # CAP-12: offset flush interval of the source connector


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """One stored table as a file stream: a single file, or a folder of part files (new files are new data).

    ``max_files_per_trigger`` limits a micro-batch, also of ``availableNow`` runs.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(path.toString())
    return reader.option("pathGlobFilter", path.getName()).parquet(sf_dir.rstrip("/"))


def read_changes(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """SRC-5: the ordered change stream landed under ``path`` (partitioned by table)."""
    return spark.readStream.schema(schema).format(fmt).load(path)


# Fixed mapping of the driver's event types to change ops.
EVENT_OPS = {"signup": "c", "error": "d"}


def events_as_changes(events: DataFrame, table: str = "public.inventory_logs") -> DataFrame:
    """The driver's ``events`` as a change log: key user_id, seq event_id;
    signup -> c, error -> d, any other type -> u."""
    op = F.when(F.col("event_type") == "signup", F.lit("c")).when(F.col("event_type") == "error", F.lit("d")) \
        .otherwise(F.lit("u"))
    return events.select(
        F.lit(table).alias("table"),
        op.alias("op"),
        F.col("event_id").alias("seq"),
        F.col("user_id"),
        F.col("event_type"),
        F.col("ts").cast("timestamp").alias("commit_ts"),
    )


def dedup_stream(stream: DataFrame, ids: list[str], ts_col: str, delay: str | None = None) -> DataFrame:
    """DER-4: drop repeated deliveries of one event.

    Without ``delay`` every id is kept in the state store (RocksDB, on disk), so
    each event's first delivery comes out however late it is. With ``delay``
    state is bounded by the watermark, and a first delivery later than it is
    dropped: only for feeds whose delay is known. ``withWatermark`` needs a
    TIMESTAMP (with zone) column, so an NTZ event time is cast first.
    """
    if delay is None:
        return stream.dropDuplicates(ids)
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return s.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(ids)


def run_available(stream: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet",
                  partition_by: list[str] | None = None, state_partitions: int | None = None) -> None:
    """Process everything available now, then stop (tests and batch catch-up).

    ``state_partitions`` fixes the number of state-store partitions of a
    stateful query when it first starts (Spark records it in the checkpoint
    and keeps it on restart); the session setting is restored afterwards.
    """
    w = stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    spark = stream.sparkSession
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        q = w.trigger(availableNow=True).start(out_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    q.awaitTermination()


def apply_stream(events: DataFrame, root: str, checkpoint: str, available_now: bool = True):
    """DER-1 stream form: land each micro-batch's last events under ``root/log``.

    ``last_events`` reduces the batch before it is written (one row per key per
    batch, deletes and snapshot rows included); the batch id names the folder, so a batch replayed after a
    failure replaces its own output instead of adding to it.

    Schema changes are checked on the driver once per batch against
    ``root/_schema.json``: new nullable fields widen the stored schema, a
    changed type fails the batch before anything is written.
    """

    # Batch ids restart with a new checkpoint (a restarted stream): the run
    # folder, derived from the checkpoint location, keeps runs apart while a
    # replay of the same run still lands on its own folder.
    run = hashlib.sha1(checkpoint.encode("utf-8")).hexdigest()[:12]

    def land(batch: DataFrame, batch_id: int) -> None:
        stored = stored_schema(batch.sparkSession, root)
        schema = batch.schema if stored is None else evolve(stored, batch.schema)
        if stored is None or schema != stored:
            write_text(batch.sparkSession, f"{root}/_schema.json", schema.json())
        conform(last_events(batch), schema).write.mode("overwrite").parquet(f"{root}/log/run={run}/batch_id={batch_id}")

    w = events.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=FLUSH_INTERVAL)
    return w.start()


def stored_schema(spark: SparkSession, root: str) -> T.StructType | None:
    text = read_text(spark, f"{root}/_schema.json")
    return None if text is None else T.StructType.fromJson(json.loads(text))


def log_batches(spark: SparkSession, root: str) -> list[str]:
    """The landed batch folders under ``root/log`` (run=*/batch_id=*), listed once."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for run in fs.listStatus(p):
        if run.isDirectory() and run.getPath().getName().startswith("run="):
            for b in fs.listStatus(run.getPath()):
                if b.isDirectory() and b.getPath().getName().startswith("batch_id="):
                    out.append(b.getPath().toString())
    return sorted(out)


def read_table(spark: SparkSession, root: str, key: list[str], base_schema: T.StructType,
               event_schema: T.StructType | None = None, keep_markers: bool = False,
               batches: list[str] | None = None) -> DataFrame:
    """Current table state: newest published base folded with the landed log.

    The log is read with the stored (evolved) event schema unless one is given;
    ``batches`` restricts the fold to a listed set of batch folders.
    """
    event_schema = event_schema or stored_schema(spark, root)
    if current_version(spark, root) is not None:
        base = read_current(spark, root, "base")
    else:
        fields = list(base_schema.fields) + [T.StructField("_seq", T.LongType()), T.StructField("_deleted", T.BooleanType())]
        base = spark.createDataFrame([], T.StructType(fields))
    paths = log_batches(spark, root) if batches is None else batches
    if not paths:
        out = base
    else:
        log = spark.read.schema(event_schema).parquet(*paths)
        out = apply_changes(base, log, key, keep_markers=True)
    if keep_markers:
        return out
    return out.filter(~F.col("_deleted")).drop("_deleted", "_seq")


def compact(spark: SparkSession, root: str, key: list[str], base_schema: T.StructType,
            event_schema: T.StructType | None = None, retire_log: bool = True,
            marker_horizon: int | None = None) -> int:
    """Fold the listed log batches into a new published base, then retire them.

    The base keeps ``_seq``/``_deleted`` markers, so a batch folded twice (or
    read again before it is retired) changes nothing. Batches that land while
    compaction runs are not in the listing and stay in the log. Delete markers
    at or below ``marker_horizon`` (a position no late event can precede any
    more) are dropped.
    """
    batches = log_batches(spark, root)
    state = read_table(spark, root, key, base_schema, event_schema, keep_markers=True, batches=batches)
    if marker_horizon is not None:
        state = state.filter(~(F.col("_deleted") & (F.col("_seq") <= F.lit(marker_horizon))))
    version = load_all(spark, root, {"base": state})
    if retire_log:
        jvm = spark._jvm
        for b in batches:
            p = jvm.org.apache.hadoop.fs.Path(b)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return version


def stream_events_to_files(spark: SparkSession, sf_dir: str, out_root: str) -> str:
    """The driver's events file as a change stream, landed by table, run to completion."""
    from changeflow.schemas import TABLES

    s = events_as_changes(table_stream(spark, sf_dir, "events", TABLES["events"]))
    out = f"{out_root}/out"
    run_available(s, out, f"{out_root}/_checkpoint", partition_by=["table"])
    return out

"""Structured Streaming: batch = stream, restart from checkpoint, stream apply, dedup."""

from pyspark.sql import functions as F

from changeflow import operators as op
from changeflow.plans import versions as V
from changeflow.schemas import TABLES, event_schema
from changeflow.streaming import changes as S
from conftest import SF_SMALL, rows


def test_stream_equals_batch(spark, scratch):
    out = S.stream_events_to_files(spark, SF_SMALL, scratch)
    streamed = spark.read.parquet(out).select("table", "op", "seq", "user_id")
    batch = S.events_as_changes(spark.read.schema(TABLES["events"]).parquet(f"{SF_SMALL}/events.parquet"))
    assert rows(streamed) == rows(batch.select("table", "op", "seq", "user_id"))


def test_restart_from_checkpoint_does_not_reprocess(spark, scratch):
    s = S.events_as_changes(S.table_stream(spark, SF_SMALL, "events", TABLES["events"]))
    S.run_available(s, f"{scratch}/out", f"{scratch}/ckpt")
    first = spark.read.parquet(f"{scratch}/out").count()
    S.run_available(s, f"{scratch}/out", f"{scratch}/ckpt")
    assert spark.read.parquet(f"{scratch}/out").count() == first
    # A new checkpoint location is a restart from the beginning (a new snapshot).
    S.run_available(s, f"{scratch}/out2", f"{scratch}/ckpt2")
    assert spark.read.parquet(f"{scratch}/out2").count() == first


def test_dedup_stream_drops_repeats(spark, scratch):
    a = S.table_stream(spark, SF_SMALL, "events", TABLES["events"])
    b = S.table_stream(spark, SF_SMALL, "events", TABLES["events"])
    s = S.dedup_stream(a.unionByName(b), ["event_id"], "ts")
    S.run_available(s.select("event_id", "ts"), f"{scratch}/out", f"{scratch}/ckpt")
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert spark.read.parquet(f"{scratch}/out").count() == n


def test_stream_apply_equals_batch_apply(spark, scratch):
    a, _, c = V.versions(spark, SF_SMALL)
    log = V.change_log(spark, SF_SMALL)
    ev_schema = log.schema
    # Land the log as files, one folder per capture, and stream it in.
    log.filter("seq = 1").write.parquet(f"{scratch}/landing/part=1")
    log.filter("seq = 2").write.parquet(f"{scratch}/landing/part=2")
    root = f"{scratch}/table"
    from changeflow.sinks import load_all

    snap = a.withColumn("_seq", F.lit(0).cast("bigint")).withColumn("_deleted", F.lit(False))
    load_all(spark, root, {"base": snap}, version=1)
    stream = spark.readStream.schema(ev_schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/landing")
    q = S.apply_stream(stream, root, f"{scratch}/ckpt")
    q.awaitTermination()
    state = S.read_table(spark, root, ["k"], a.schema, ev_schema)
    assert rows(state) == rows(c)
    # Compaction folds the log into a new base with the same content and retires the batches.
    assert len(S.log_batches(spark, root)) == 2
    S.compact(spark, root, ["k"], a.schema, ev_schema)
    assert S.log_batches(spark, root) == []
    assert rows(S.read_table(spark, root, ["k"], a.schema, ev_schema)) == rows(c)
    markers = S.read_table(spark, root, ["k"], a.schema, ev_schema, keep_markers=True).filter("_deleted").count()
    assert markers > 0
    S.compact(spark, root, ["k"], a.schema, ev_schema, marker_horizon=2)
    state = S.read_table(spark, root, ["k"], a.schema, ev_schema, keep_markers=True)
    assert state.filter("_deleted").count() == 0 and rows(state.drop("_seq", "_deleted")) == rows(c)


def test_typed_event_schema_roundtrip(spark):
    a, b, _ = V.versions(spark, SF_SMALL)
    ev = op.capture(a, b, V.TABLE, ["k"], 1)
    key_t = ev.schema["key"].dataType
    row_t = ev.schema["after"].dataType
    assert [f.name for f in event_schema(key_t, row_t).fields] == ev.columns


def test_stream_apply_widens_schema_and_rejects_type_change(spark, scratch):
    import pytest
    from pyspark.sql import types as T

    key_t = T.StructType([T.StructField("id", T.IntegerType())])
    row1 = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType())])
    row2 = T.StructType(list(row1.fields) + [T.StructField("w", T.StringType())])
    e1 = spark.createDataFrame([("t", "c", (1,), None, (1, "a"), None, 1)], event_schema(key_t, row1))
    e2 = spark.createDataFrame([("t", "c", (2,), None, (2, "b", "x"), None, 2)], event_schema(key_t, row2))
    root = f"{scratch}/table"
    for i, e in enumerate([e1, e2]):
        e.write.parquet(f"{scratch}/landing{i}")
        s = spark.readStream.schema(e.schema).parquet(f"{scratch}/landing{i}")
        S.apply_stream(s, root, f"{scratch}/ckpt{i}").awaitTermination()
    stored = S.stored_schema(spark, root)
    assert stored["after"].dataType.fieldNames() == ["id", "v", "w"]
    got = S.read_table(spark, root, ["id"], row2)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", None), (2, "b", "x")]
    bad_row = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.StringType())])
    e3 = spark.createDataFrame([("t", "c", (3,), None, ("3", "c"), None, 3)], event_schema(key_t, bad_row))
    e3.write.parquet(f"{scratch}/landing3")
    s = spark.readStream.schema(e3.schema).parquet(f"{scratch}/landing3")
    with pytest.raises(Exception, match="SchemaChangeError|field 'after'|field 'id'"):
        S.apply_stream(s, root, f"{scratch}/ckpt3").awaitTermination()

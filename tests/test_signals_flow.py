"""Signals (ad-hoc snapshots), the streaming flow and bucketed keyed storage."""

from pyspark.sql import functions as F

from changeflow import operators as op
from changeflow.plans import mixed
from changeflow.plans import versions as V
from changeflow.plans.registry import _value_struct, kafka_records
from changeflow.schemas import SIGNAL_DOC
from changeflow.sinks import write_bucketed
from changeflow.streaming.flow import start_flow
from conftest import SF_SMALL, rows


def test_snapshot_requests_dedup_and_filter(spark):
    sig = spark.createDataFrame(
        [("s1", "execute-snapshot", '{"data-collections": ["public.orders", "public.secret"], "type": "incremental"}'),
         ("s1", "execute-snapshot", '{"data-collections": ["public.orders", "public.secret"], "type": "incremental"}'),
         ("s2", "log", '{"message": "hi"}')],
        SIGNAL_DOC)
    lst = spark.createDataFrame([(t,) for t in mixed.SCENARIO_TABLES], "table string")
    got = [tuple(r) for r in op.snapshot_requests(sig, lst).collect()]
    assert got == [("public.orders", "s1", "incremental")]


def test_chunked_snapshot_yields_to_the_log(spark):
    a, b, _ = V.versions(spark, SF_SMALL)
    window = op.capture(a, b, V.TABLE, ["k"], 5)
    snap = op.chunked_snapshot(a, V.TABLE, ["k"], 1, 100, window_events=window)
    changed = window.filter(F.col("op") != "c").count()
    assert snap.count() == a.count() - changed
    assert snap.select(F.max("chunk")).first()[0] == a.agg(F.max("k")).first()[0] // 100
    # Snapshot chunk followed by the window's log reproduces the new version.
    state = op.apply_changes(a.limit(0), snap.unionByName(window.withColumn("chunk", F.lit(None))).drop("chunk"), ["k"])
    assert rows(state) == rows(b)


def test_stream_flow_equals_batch_records(spark, scratch):
    log = V.change_log(spark, SF_SMALL)
    log.write.parquet(f"{scratch}/landing")
    stream = spark.readStream.schema(log.schema).parquet(f"{scratch}/landing")
    q = start_flow(stream, ["public.orders"], [], mixed.TOPIC_PREFIX, _value_struct(), f"{scratch}/ckpt",
                   f"{scratch}/out")
    q.awaitTermination()
    assert rows(spark.read.parquet(f"{scratch}/out")) == rows(kafka_records(spark, SF_SMALL))


def test_bucketed_versions_capture_without_shuffle(spark, scratch):
    a, b, _ = V.versions(spark, SF_SMALL)
    write_bucketed(a, "orders_v1", ["k"], 8, f"{scratch}/v1")
    write_bucketed(b, "orders_v2", ["k"], 8, f"{scratch}/v2")
    ev = op.capture(spark.table("orders_v1"), spark.table("orders_v2"), V.TABLE, ["k"], 1)
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert rows(ev, "op") == rows(op.capture(a, b, V.TABLE, ["k"], 1), "op")


def _files(path):
    import os

    out = {}
    for d in sorted(os.listdir(path)):
        if d.startswith("_bucket="):
            out[d] = sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet"))
    return out


def test_bucketed_upsert_rewrites_only_touched_buckets(spark, scratch):
    a, b, _ = V.versions(spark, SF_SMALL)
    path = f"{scratch}/orders"
    op.write_buckets(a, path, ["k"], 16)
    before = _files(path)
    src = b.filter(F.col("k").isin(1, 2, 11)).select("k", "status", "total")
    touched = op.upsert_buckets(spark, path, src, ["k"], ["status"], 16)
    after = _files(path)
    assert 0 < len(touched) <= 3
    for d in before:
        bucket = int(d.split("=")[1])
        assert (after[d] == before[d]) == (bucket not in touched)
    got = op.read_buckets(spark, path).drop("_bucket")
    assert rows(got) == rows(op.upsert(a, src, ["k"], ["status"]))


def test_bucketed_apply_equals_batch_apply(spark, scratch):
    a, _, c = V.versions(spark, SF_SMALL)
    path = f"{scratch}/orders"
    op.write_buckets(a, path, ["k"], 8)
    op.apply_buckets(spark, path, V.change_log(spark, SF_SMALL), ["k"], 8)
    assert rows(op.read_buckets(spark, path).drop("_bucket")) == rows(c)


def test_per_key_order_keeps_a_keys_events_together_and_sorted(spark):
    log = V.change_log(spark, SF_SMALL).repartition(5)
    tagged = op.per_key_order(log).withColumn("pid", F.spark_partition_id()).select("pid", "key.k", "seq")
    per_key = tagged.groupBy("k").agg(F.countDistinct("pid").alias("parts"))
    assert per_key.filter("parts > 1").count() == 0
    for part in tagged.rdd.glom().collect():
        seen = {}
        for r in part:
            assert seen.get(r["k"], -1) <= r["seq"]
            seen[r["k"]] = r["seq"]


def test_flow_with_processing_time_trigger(spark, scratch):
    log = V.change_log(spark, SF_SMALL)
    log.write.parquet(f"{scratch}/landing")
    stream = spark.readStream.schema(log.schema).parquet(f"{scratch}/landing")
    q = start_flow(stream, ["public.orders"], [], mixed.TOPIC_PREFIX, _value_struct(), f"{scratch}/ckpt",
                   f"{scratch}/out", available_now=False)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(f"{scratch}/out").count() == log.count()


def test_parse_json_array_tags(spark):
    df = spark.createDataFrame([(1, '["a", "b"]'), (2, None), (3, "[]")], "id int, tags string")
    out = {r["id"]: r["tags"] for r in op.parse_json_array(df, "tags").collect()}
    assert out == {1: ["a", "b"], 2: None, 3: []}


def test_kafka_path_is_gated(spark, scratch):
    import pytest

    from changeflow.streaming.flow import kafka_available, read_kafka_changes

    if kafka_available(spark):
        pytest.skip("Kafka connector present")
    log = V.change_log(spark, SF_SMALL)
    log.write.parquet(f"{scratch}/landing")
    stream = spark.readStream.schema(log.schema).parquet(f"{scratch}/landing")
    with pytest.raises(RuntimeError, match="Kafka connector"):
        start_flow(stream, ["public.orders"], [], mixed.TOPIC_PREFIX, _value_struct(), f"{scratch}/ckpt",
                   fmt="kafka", options={"kafka.bootstrap.servers": "unused:9092", "topic": "t"})
    with pytest.raises(RuntimeError, match="Kafka connector"):
        read_kafka_changes(spark, "unused:9092", ["t"], log.schema)


def test_bucket_layout_spreads_each_bucket_over_writers(spark, scratch):
    import os

    a, _, _ = V.versions(spark, SF_SMALL)
    path = f"{scratch}/orders"
    op.write_buckets(a, path, ["k"], 4, writers_per_bucket=3)
    (run,) = [f"{path}/{d}" for d in os.listdir(path) if d.startswith("_run=")]
    per_bucket = [len([f for f in os.listdir(f"{run}/{d}") if f.endswith(".parquet")])
                  for d in os.listdir(run) if d.startswith("_bucket=")]
    assert len(per_bucket) == 4 and all(1 < n <= 3 for n in per_bucket)
    assert rows(op.read_buckets(spark, path).drop("_bucket")) == rows(a)


def test_ordered_flow_delivers_each_key_in_seq_order(spark, scratch):
    import json as _json

    log = V.change_log(spark, SF_SMALL)
    log.write.parquet(f"{scratch}/landing")
    stream = spark.readStream.schema(log.schema).parquet(f"{scratch}/landing")
    start_flow(stream, ["public.orders"], [], mixed.TOPIC_PREFIX, _value_struct(), f"{scratch}/ckpt",
               f"{scratch}/out", ordered=True).awaitTermination()
    out = spark.read.parquet(f"{scratch}/out")
    assert rows(out.drop("batch_id")) == rows(kafka_records(spark, SF_SMALL))
    tagged = out.withColumn("pid", F.spark_partition_id()).withColumn("f", F.input_file_name())
    files = {}
    for r in tagged.select("f", "key", "value").collect():
        files.setdefault(r["f"], []).append((r["key"], int(_json.loads(r["value"])["seq"])))
    for recs in files.values():
        last = {}
        for k, s in recs:
            assert last.get(k, -1) <= s
            last[k] = s

"""Sinks: table modes, all-or-nothing loads, record shapes, HTTP delivery."""

import json
import os

import pytest
from pyspark.sql import functions as F

from changeflow import sinks
from changeflow.sinks import http


def test_table_modes(spark, scratch):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2,), (3,)], "x int")
    p = f"{scratch}/t"
    sinks.create_if_absent(a, p)
    sinks.create_if_absent(b, p)
    assert spark.read.parquet(p).count() == 1
    sinks.append(b, p)
    assert spark.read.parquet(p).count() == 3
    sinks.reset(b, p)
    sinks.reset(b, p)
    assert spark.read.parquet(p).count() == 2


def test_load_all_is_all_or_nothing(spark, scratch):
    root = f"{scratch}/db"
    v1 = sinks.load_all(spark, root, {"a": spark.range(3), "b": spark.range(5)}, version=1)
    assert sinks.current_version(spark, root) == v1
    bad = spark.range(4).select((F.col("id") / F.lit(0)).cast("int").alias("id"))  # fails under ANSI
    with pytest.raises(Exception):
        sinks.load_all(spark, root, {"a": spark.range(10), "b": bad}, version=2)
    assert sinks.current_version(spark, root) == 1
    assert sinks.read_current(spark, root, "a").count() == 3


def test_avro_safe_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`order-id` int, `1st` int, ok_name int")
    assert sinks.avro_safe_names(df).columns == ["order_id", "_1st", "ok_name"]


def test_json_with_schema(spark):
    df = spark.createDataFrame([(1, "a")], "id bigint, name string")
    v = json.loads(df.select(sinks.json_with_schema(df, ["id", "name"], "t.Value").alias("v")).first()["v"])
    assert v["payload"] == {"id": 1, "name": "a"}
    assert [f["type"] for f in v["schema"]["fields"]] == ["int64", "string"]


def test_kafka_string_records(spark):
    df = spark.createDataFrame([("t", 1, None)], "table string, k int, v string")
    rec = sinks.to_kafka_string(df, F.col("table"), F.struct("k"), F.struct("v")).first()
    assert (rec["topic"], rec["key"], rec["value"]) == ("t", '{"k":1}', '{"v":null}')


def test_http_sink_delivers_every_row(spark, scratch):
    http.register(spark)
    df = spark.range(0, 1234).select(F.col("id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    (df.repartition(4).write.format("changeflow_http").mode("append")
     .option("url", f"file://{scratch}").option("batchSize", "100")
     .option("transport", "changeflow.sinks.http:file_transport").save())
    got = []
    for name in os.listdir(scratch):
        with open(os.path.join(scratch, name)) as f:
            got.extend(json.loads(f.read()))
    assert sorted(r["id"] for r in got) == list(range(1234))


def test_http_stream_writer_delivers_each_batch(spark, scratch):
    import os

    http.register(spark)
    out = f"{scratch}/recv"
    os.makedirs(out)
    src = f"{scratch}/src"
    spark.range(0, 500).write.parquet(src)
    stream = spark.readStream.schema("id bigint").parquet(src)
    q = (stream.writeStream.format("changeflow_http").option("url", f"file://{out}")
         .option("transport", "changeflow.sinks.http:file_transport")
         .option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    got = []
    for name in os.listdir(out):
        with open(os.path.join(out, name)) as f:
            got.extend(json.loads(f.read()))
    assert sorted(r["id"] for r in got) == list(range(500))

"""Replays, ids, bucket rewrites, streams over folders and strict checks at sizes where they used to fail."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow import operators as op
from changeflow.operators.mutate import find_or_create
from changeflow.session import checkpoint_root
from changeflow.sinks.records import avro_safe_names, json_with_schema, to_kafka_string
from changeflow.streaming import changes as S

EVENT = "table string, op string, key struct<id:int>, before struct<id:int,v:string>, after struct<id:int,v:string>, commit_ts timestamp, seq long"


def ev(o, i, seq, v=None):
    row = None if o == "d" else (i, v)
    return ("t", o, (i,), None, row, None, seq)


def state(df):
    return sorted((r.id, r.v) for r in df.collect())


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "id int, v string, _seq long")


def test_ids_stay_dense_with_payload_columns(spark, scratch):
    spark.range(0, 1_000_000, 1, 9).select((F.col("id") * 7919 % 1_000_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload")).write.parquet(f"{scratch}/t")
    out = op.assign_ids(spark.read.parquet(f"{scratch}/t"), 5, ["k"], partitions=12)
    out.write.parquet(f"{scratch}/out")
    back = spark.read.parquet(f"{scratch}/out")
    assert back.filter(F.col("id") != F.col("k") + 5).count() == 0 and back.count() == 1_000_000
    assert back.select("id").distinct().count() == 1_000_000


def test_snapshot_rows_are_installed_and_deletes_kept(spark, empty):
    snap = spark.createDataFrame([ev("r", 1, 0, "a"), ev("r", 2, 0, "b")], EVENT)
    assert state(op.apply_changes(empty, snap, ["id"])) == [(1, "a"), (2, "b")]
    held = spark.createDataFrame([(1, "x", 1)], "id int, v string, _seq long")
    log = spark.createDataFrame([ev("c", 1, 1, "x"), ev("d", 1, 2)], EVENT)
    assert state(op.apply_changes(held, log, ["id"])) == []
    gone = op.apply_changes(empty, spark.createDataFrame([ev("c", 9, 5, "x"), ev("d", 9, 6)], EVENT), ["id"], keep_markers=True)
    late = spark.createDataFrame([ev("u", 9, 5, "late")], EVENT)
    assert state(op.apply_changes(gone, late, ["id"])) == []


def test_equal_positions(spark, empty):
    same = spark.createDataFrame([ev("u", 1, 3, "a"), ev("u", 1, 3, "a")], EVENT)
    assert state(op.apply_changes(empty, same, ["id"])) == [(1, "a")] and op.net_changes(same).count() == 1
    other = spark.createDataFrame([ev("u", 1, 3, "a"), ev("u", 1, 3, "b")], EVENT)
    for run in (lambda: op.apply_changes(empty, other, ["id"]).collect(), lambda: op.net_changes(other).collect(), lambda: op.net_changes(other).count()):
        with pytest.raises(Exception, match="equal seq"):
            run()


def test_a_bucket_emptied_by_deletes_is_empty(spark, scratch):
    path = f"{scratch}/t"
    op.write_buckets(spark.createDataFrame([(i, str(i)) for i in range(6)], "id int, v string"), path, ["id"], 16)
    before = op.read_buckets(spark, path)
    op.apply_buckets(spark, path, spark.createDataFrame([ev("d", i, 1) for i in (0, 2, 4)], EVENT), ["id"], 16)
    assert sorted(r.id for r in op.read_buckets(spark, path).collect()) == [1, 3, 5]
    assert before.count() == 6  # a reader that started before sees the table as it was
    op.apply_buckets(spark, path, spark.createDataFrame([ev("d", i, 2) for i in range(6)], EVENT), ["id"], 16)
    assert op.read_buckets(spark, path).count() == 0
    op.upsert_buckets(spark, path, spark.createDataFrame([(7, "x")], "id int, v string"), ["id"], ["v"], 16)
    assert [(r.id, r.v) for r in op.read_buckets(spark, path).collect()] == [(7, "x")]


def test_streams_read_folders_and_keep_late_first_deliveries(spark, scratch):
    schema = T.StructType.fromDDL("event_id long, ts timestamp")
    for i in range(5):
        day = 9 - 2 * i  # every file is days earlier than the one before
        spark.createDataFrame([(i, None)], schema).withColumn("ts", F.to_timestamp(F.lit(f"2026-01-{day:02d}"))).write.mode("append").parquet(f"{scratch}/events.parquet")
    stream = S.table_stream(spark, scratch, "events", schema, max_files_per_trigger=1)
    S.run_available(S.dedup_stream(stream.unionByName(stream), ["event_id"], "ts"), f"{scratch}/out", f"{scratch}/_c")
    assert sorted(r.event_id for r in spark.read.parquet(f"{scratch}/out").collect()) == [0, 1, 2, 3, 4]


def test_stream_replay_keeps_snapshot_rows_and_deletes(spark, scratch):
    batches = [[ev("r", 1, 0, "a"), ev("r", 2, 0, "b")], [ev("c", 3, 1, "c"), ev("d", 3, 2), ev("u", 1, 3, "z"), ev("d", 2, 4)]]
    schema = spark.createDataFrame([], EVENT).schema
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{scratch}/in/b{i}")
        S.apply_stream(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{scratch}/in"), f"{scratch}/table", f"{scratch}/_c").awaitTermination()
    base = T.StructType.fromDDL("id int, v string")
    assert state(S.read_table(spark, f"{scratch}/table", ["id"], base)) == [(1, "z")]


def test_tombstones_have_no_value(spark):
    log = op.tombstones(spark.createDataFrame([ev("d", 1, 1), ev("u", 2, 2, "x")], EVENT), on=True)
    out = to_kafka_string(log, F.lit("t"), F.col("key"), F.struct("op", "after")).collect()
    assert sorted((json.loads(r.key)["id"], r.value is None) for r in out) == [(1, False), (1, True), (2, False)]


def test_payload_in_the_schemas_encoding(spark):
    rows = [("12.34", "BNI="), ("-0.01", "/w=="), ("1.28", "AIA="), ("-1.28", "gA=="), ("0.00", "AA==")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string").select(F.col("a").cast("decimal(9,2)").alias("d"), F.lit("2026-01-01 00:00:01.5").cast("timestamp").alias("at"))
    got = [json.loads(r.v)["payload"] for r in df.select(json_with_schema(df, ["d", "at"], "n").alias("v")).collect()]
    assert [x["d"] for x in got] == [b for _, b in rows] and {x["at"] for x in got} == {1767225601500}


def test_strict_lookup_fails_whatever_is_read(spark):
    df, dim = spark.createDataFrame([(1, 5), (2, 6)], "id int, fk int"), spark.createDataFrame([(5, "x")], "k int, name string")
    out = op.strict_lookup(df, dim, [("fk", "k")], ["name"])
    for run in (out.collect, out.count, out.select("id").collect):
        with pytest.raises(Exception, match="unresolved"):
            run()
    assert op.strict_lookup(df.filter("fk = 5"), dim, [("fk", "k")], ["name"]).count() == 1


def test_duplicate_source_keys(spark):
    target, src = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(2, "y"), (2, "x"), (3, "z")], "id int, v string")
    with pytest.raises(Exception, match="duplicate source key"):
        op.upsert(target, src, ["id"], ["v"]).count()
    assert state(op.insert_if_absent(target, src, ["id"])) == [(1, "a"), (2, "x"), (3, "z")]
    named = spark.createDataFrame([("n", "q"), ("n", "p")], "name string, note string")
    _, table = find_or_create(spark.createDataFrame([], "name string, note string, id long"), named, ["name"], "id")
    assert [(r.name, r.note) for r in table.collect()] == [("n", "p")]


def test_nest_has_one_document_per_key_or_bounded_chunks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.lit("same").alias("v"))
    assert [(r.chunk, len(r["items"])) for r in op.nest(df, ["k"], ["v"]).collect()] == [(0, 20_000)]
    assert sorted((r.chunk, len(r["items"])) for r in op.nest(df, ["k"], ["v"], max_items=6_000).collect()) == [(0, 6000), (1, 6000), (2, 6000), (3, 2000)]


def test_avro_names(spark):
    df = spark.createDataFrame([((1,), 2)], "`a-b` struct<`c.d`:int>, `2x` int")
    assert avro_safe_names(df).schema.simpleString() == "struct<a_b:struct<c_d:int>,_2x:int>"
    with pytest.raises(ValueError, match="collide"):
        avro_safe_names(spark.createDataFrame([(1, 2)], "`a-b` int, a_b int"))


def test_checkpoint_root_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False
                        return Nothing
                return Sc

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session)


def test_model_of_the_second_relational_source(spark):
    from changeflow.operators.checks import foreign_keys, uniques
    from changeflow.schemas import SQLSERVER, SQLSERVER_FKS, SQLSERVER_UNIQUE

    def rows_of(table, *rows):
        schema = SQLSERVER[table][0]
        full = [tuple({**dict.fromkeys(schema.names), **r}[c] for c in schema.names) for r in rows]
        return spark.createDataFrame(full, T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))

    frames = {
        "categories": rows_of("categories", {"id": "c1"}),
        "products": rows_of("products", {"id": "p1", "category_id": None}, {"id": "p2", "category_id": "c9"}),
        "users": rows_of("users", {"id": "u1", "username": "a", "email": "e"}, {"id": "u2", "username": "a", "email": "f"}),
        "orders": rows_of("orders", {"id": "o1", "user_id": "u1"}),
        "order_items": rows_of("order_items", {"order_id": "o1", "product_id": "p1"}, {"order_id": "o1", "product_id": "p1"}),
    }
    orphans = [(r.fk, r.ref) for r in foreign_keys(frames, SQLSERVER_FKS).collect()]
    assert orphans == [("products.category_id->categories", "c9")]
    keys = [(t, key) for t, (_, key) in SQLSERVER.items()] + SQLSERVER_UNIQUE
    assert sorted((r["index"], r.n) for r in uniques(frames, keys).collect()) == [("order_items(order_id,product_id)", 2), ("users(username)", 2)]


def test_restricted_delete(spark):
    from changeflow.operators.mutate import restrict_delete

    users, orders = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(10, 1), (11, None)], "o int, user_id int")
    free = spark.createDataFrame([(2,), (9,)], "id int")
    assert sorted(r.id for r in restrict_delete(users, free, ["id"], [(orders, ["user_id"])]).collect()) == [1, 3]
    for run in ("count", "collect"):
        with pytest.raises(Exception, match="still referenced"):
            getattr(restrict_delete(users, spark.createDataFrame([(1,)], "id int"), ["id"], [(orders, ["user_id"])]), run)()

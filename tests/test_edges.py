"""Edge rows: the hand-written log, NULL references, empty tables, overflow, failures."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow import operators as op
from changeflow.schemas import event_schema

KEY_T = T.StructType([T.StructField("id", T.IntegerType())])
ROW_T = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType())])


def _ev(key, o, seq, before, after):
    return ("t", o, (key,), None if before is None else (key, before), None if after is None else (key, after),
            None, seq)


# Fixed log of FIXTURES.md section 5 (keys 1..7).
LOG = [
    _ev(1, "c", 1, None, "a"),
    _ev(2, "c", 1, None, "a"), _ev(2, "u", 2, "a", "b"),
    _ev(3, "c", 1, None, "a"), _ev(3, "d", 2, "a", None),
    _ev(4, "r", 0, None, "a"), _ev(4, "u", 1, "a", "b"), _ev(4, "u", 2, "b", "c"),
    _ev(5, "r", 0, None, "a"), _ev(5, "d", 1, "a", None),
    _ev(6, "r", 0, None, "a"), _ev(6, "d", 1, "a", None), _ev(6, "c", 2, None, "z"),
    _ev(7, "r", 0, None, "a"), _ev(7, "u", 1, "a", "b"), _ev(7, "u", 2, "b", "a"),
]


@pytest.fixture()
def log(spark):
    return spark.createDataFrame(LOG, event_schema(KEY_T, ROW_T))


def _net(df):
    return {r["key"]["id"]: r["op"] for r in df.collect()}


def test_net_changes_of_the_fixture_log(log):
    assert _net(op.net_changes(log)) == {1: "c", 2: "c", 4: "u", 5: "d", 6: "u", 7: "u"}
    assert _net(op.net_changes(log, drop_noop=True)) == {1: "c", 2: "c", 4: "u", 5: "d", 6: "u"}


def test_apply_fixture_log(spark, log):
    start = spark.createDataFrame([(4, "a"), (5, "a"), (6, "a"), (7, "a")], ROW_T)
    out = {r["id"]: r["v"] for r in op.apply_changes(start, log, ["id"]).collect()}
    assert out == {1: "a", 2: "b", 4: "c", 6: "z", 7: "a"}


def test_deleted_key_stays_deleted_against_an_older_event(spark, log):
    start = spark.createDataFrame([(5, "a")], ROW_T).withColumn("_seq", F.lit(0).cast("bigint"))
    state = op.apply_changes(start, log.filter(F.col("key.id") == 5), ["id"], keep_markers=True)
    late = spark.createDataFrame([_ev(5, "u", 0, "a", "late")], event_schema(KEY_T, ROW_T))
    again = op.apply_changes(state, late, ["id"], keep_markers=True).collect()
    assert len(again) == 1 and again[0]["_deleted"] and again[0]["_seq"] == 1


def test_null_foreign_key_passes(spark):
    child = spark.createDataFrame([(1, None), (2, 10), (3, 99)], "id int, cat int")
    parent = spark.createDataFrame([(10,)], "cat_id int")
    assert [r["id"] for r in op.foreign_key(child, parent, [("cat", "cat_id")]).collect()] == [3]


def test_next_id_on_empty_table_is_two(spark):
    empty = spark.createDataFrame([], "id int")
    assert op.next_id(empty, "id") == 2
    assert op.next_id(spark.createDataFrame([(7,)], "id int"), "id") == 8


def test_assign_ids_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 3).alias("x")).repartition(5)
    out = op.assign_ids(df, 100, ["x"], partitions=4).orderBy("x").collect()
    assert [r["id"] for r in out] == list(range(100, 1100))


def test_decimal_overflow_raises(spark):
    df = spark.createDataFrame([(Decimal("99999999.99"),)], "p decimal(10,2)")
    with pytest.raises(Exception):
        df.select((F.col("p") * 100).cast("decimal(10,2)").alias("q")).collect()


def test_strict_lookup_fails_on_unresolved(spark):
    df = spark.createDataFrame([(1,), (2,)], "ref int")
    dim = spark.createDataFrame([(1, "x")], "id int, name string")
    ok = op.strict_lookup(df.filter("ref = 1"), dim, [("ref", "id")], ["name"])
    assert ok.collect()[0]["name"] == "x"
    with pytest.raises(Exception, match="unresolved"):
        op.strict_lookup(df, dim, [("ref", "id")], ["name"]).collect()


def test_fill_defaults_keeps_explicit_null(spark):
    df = spark.createDataFrame([(1, None)], "id int, stock int")
    out = op.fill_defaults(df, {"stock": F.lit(0), "updated_at": F.lit("x")}).collect()[0]
    assert out["stock"] is None and out["updated_at"] == "x"


def test_checks_on_clean_and_dirty_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, ""), (2, None)], "id int, name string")
    assert op.unique(df, ["id"]).collect()[0]["n"] == 2
    assert op.not_null(df, ["name"]).count() == 1
    assert op.required(df, "name").count() == 2
    assert op.max_length(df, "name", 0).count() == 1


def test_conditional_transform_null_predicate(spark):
    df = spark.createDataFrame([("error", 1), (None, 2), ("view", 3)], "t string, v int")
    out = op.transform_if(df, lambda d: {"v": F.lit(0)}, F.col("t") == "error", negate=True)
    assert sorted(r["v"] for r in out.collect()) == [0, 0, 1]
    assert sorted(r["v"] for r in op.transform_if(df, lambda d: {"v": F.lit(0)}).collect()) == [0, 0, 0]
    assert op.chain(df, []).collect() == df.collect()


def test_include_filters(spark):
    df = spark.createDataFrame([("ecommerce.data.orders",), ("public.users",), ("ecommerce.products",), ("bare",)],
                               "table string")
    assert [r[0] for r in op.include_schemas(df, ["data"]).collect()] == ["ecommerce.data.orders"]
    assert sorted(r[0] for r in op.include_databases(df, ["ecommerce"]).collect()) == [
        "ecommerce.data.orders", "ecommerce.products"]


def test_unwrap_null_mode_keeps_delete_keys(log):
    out = op.unwrap(log, deletes="null").filter(F.col("op") == "d").collect()
    assert sorted(r["id"] for r in out) == [3, 5, 6]
    assert all(r["v"] is None for r in out)


def test_handoff_drops_log_rows_covered_by_snapshot(spark, log):
    snap = log.filter(F.col("op") == "r")
    out = op.handoff(snap, log.filter(F.col("op") != "r"), 1)
    assert out.filter(F.col("op") != "r").agg(F.min("seq")).first()[0] == 2


def test_equal_seq_is_rejected(spark, log):
    dup = log.unionByName(log.filter(F.col("key.id") == 2))
    with pytest.raises(ValueError, match="equal seq"):
        op.require_ordered(dup)
    op.require_ordered(log)
    start = spark.createDataFrame([], ROW_T)
    with pytest.raises(ValueError):
        op.apply_changes(start, dup, ["id"], strict=True)


def test_schema_evolution_rules(spark):
    from changeflow.schemas import SchemaChangeError, conform, evolve

    cur = T.StructType([T.StructField("id", T.IntegerType()),
                        T.StructField("user", T.StructType([T.StructField("name", T.StringType())]))])
    inc = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("tags", T.ArrayType(T.StringType())),
                        T.StructField("user", T.StructType([T.StructField("email", T.StringType())]))])
    out = evolve(cur, inc)
    assert out.fieldNames() == ["id", "user", "tags"]
    assert out["user"].dataType.fieldNames() == ["name", "email"]
    with pytest.raises(SchemaChangeError):
        evolve(cur, T.StructType([T.StructField("id", T.StringType())]))
    df = spark.createDataFrame([(1,)], "id int")
    assert conform(df, out).columns == ["id", "user", "tags"]


def test_mixed_stream_roundtrip(spark):
    from changeflow.plans import versions as V
    from conftest import SF_SMALL, rows

    log = V.change_log(spark, SF_SMALL)
    other = log.withColumn("table", F.lit("public.users"))
    mixed = op.to_mixed(log).unionByName(op.to_mixed(other))
    key_t, row_t = log.schema["key"].dataType, log.schema["after"].dataType
    back = op.from_mixed(mixed, V.TABLE, key_t, row_t)
    assert rows(back, "key", "op", "seq", "after") == rows(log, "key", "op", "seq", "after")


def test_seed_outputs_match_relational_schemas(spark):
    from changeflow.operators import seed
    from changeflow.schemas import RELATIONAL
    from changeflow.sources import series

    ids = series(spark, 1, 10)
    made = {
        "categories": seed.seed_categories(ids), "products": seed.seed_products(ids), "users": seed.seed_users(ids),
        "orders": seed.seed_orders(ids), "order_items": seed.seed_order_items(ids),
        "payments": seed.seed_payments(ids), "inventory_logs": seed.seed_inventory_logs(ids),
    }
    for name, df in made.items():
        want = RELATIONAL[name][0]
        assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in want.fields], name


def test_find_or_create_returns_existing_ids(spark):
    target = spark.createDataFrame([(1, "kafka"), (2, "pg")], "id bigint, name string")
    src = spark.createDataFrame([("pg", "x"), ("mongo", "y"), ("mongo", "z"), ("http", "w")], "name string, note string")
    resolved, table = op.find_or_create(target, src, ["name"], "id")
    got = sorted((r["name"], r["note"], r["id"]) for r in resolved.collect())
    assert got == [("http", "w", 3), ("mongo", "y", 4), ("mongo", "z", 4), ("pg", "x", 2)]
    assert sorted((r["id"], r["name"]) for r in table.collect()) == [(1, "kafka"), (2, "pg"), (3, "http"), (4, "mongo")]
    again, table2 = op.find_or_create(table, src, ["name"], "id")
    assert sorted(r["id"] for r in again.collect()) == [2, 3, 4, 4]
    assert table2.count() == 4


def test_unwrap_rewrite_mode_flags_deletes(log):
    out = {(r["id"], r["seq"]): (r["v"], r["__deleted"]) for r in op.unwrap(log, deletes="rewrite").collect()}
    assert out[(3, 2)] == ("a", "true") and out[(2, 2)] == ("b", "false")
    with pytest.raises(ValueError):
        op.unwrap(log, deletes="keep")

"""The registered queries: one per inventory item, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or frames Spark derives from them)
whole; outputs are flat and every computed column is aliased to the name
its DuckDB oracle (``plans.oracle``) uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow import operators as op
from changeflow.functions.expressions import ts_ntz
from changeflow.operators import seed
from changeflow.plans import incremental, mixed, versions
from changeflow.plans.versions import KEY, TABLE, change_log, flat_event, v1, v2_from
from changeflow.schemas import ALL_TABLES, TABLES
from changeflow.session import settle, shared_dir
from changeflow.sinks.records import avro_safe_names, json_with_schema, to_kafka_string
from changeflow.sources import catalog
from changeflow.sinks import tables as sinks
from changeflow.sources.tables import scan_documents, scan_table, series
from changeflow.streaming import changes as streams

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2026-01-01 00:00:00"
AS_OF_2 = "2026-02-01 00:00:00"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return scan_table(spark, d, name)


# --------------------------------------------------------------------------- scans, filters


def scan_orders(spark, d):
    return _t(spark, d, "orders")


def stored_documents(spark, d):
    """SRC-4: orders written as nested JSON documents and read back with the declared schema."""
    docs = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("_id"), F.struct(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status")).alias("order"))
    path = f"{shared_dir(spark, 'documents')}/orders"
    docs.write.json(path)
    back = scan_documents(spark, path, docs.schema)
    return back.select("_id", F.col("order.user_id").alias("user_id"), F.col("order.status").alias("status"))


def key_gaps(spark, d):
    """SRC-6: keys between the smallest and the largest order key that no order has (o_orderstatus null), and the same within each status."""
    o = _t(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    lo, hi = o.agg(F.coalesce(F.min("o_orderkey"), F.lit(0)), F.coalesce(F.max("o_orderkey"), F.lit(-1))).first()
    keys = series(spark, lo, hi, "o_orderkey")
    spans = o.filter("o_orderstatus IS NOT NULL").groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    spans = spans.agg(F.collect_list(F.struct("o_orderstatus", "lo", "hi"))).scalar()
    each = keys.select("o_orderkey", spans.alias("spans")).select("o_orderkey", F.inline("spans")).filter("o_orderkey BETWEEN lo AND hi").select("o_orderstatus", "o_orderkey")
    of_all = op.absent_in(keys, o, ["o_orderkey"]).select(F.lit(None).cast("string").alias("o_orderstatus"), "o_orderkey")
    return of_all.unionByName(op.absent_in(each, o, ["o_orderstatus", "o_orderkey"]))


def written_tables(spark, d):
    """SNK-1, 2, 3: V2 written, replaced by the even keys of V1, the odd ones appended, and V2 offered to the table that is there."""
    o = v1(spark, d)
    path = f"{shared_dir(spark, 'written')}/orders"
    sinks.reset(v2_from(o), path)
    sinks.reset(o.filter(F.col("k") % 2 == 0), path)
    sinks.append(o.filter(F.col("k") % 2 != 0), path)
    sinks.create_if_absent(v2_from(o), path)
    return spark.read.parquet(path)


def loaded_together(spark, d):
    """MUT-7: orders and customers published as one version, then V2 and the customers of even keys as the next; what stands is read row by row."""
    root = shared_dir(spark, "loaded")
    o, c = v1(spark, d), _t(spark, d, "customer")
    first = sinks.load_all(spark, root, {"orders": o, "users": c})
    sinks.load_all(spark, root, {"orders": v2_from(o), "users": c.filter(F.col("c_custkey") % 2 == 0)}, version=first + 1)
    orders, users = sinks.read_current(spark, root, "orders"), sinks.read_current(spark, root, "users")
    return orders.select(F.lit("orders").alias("name"), "k", F.col("status").alias("value")).unionByName(
        users.select(F.lit("users").alias("name"), F.col("c_custkey").alias("k"), F.col("c_name").alias("value")))


def orders_by_status(spark, d):
    return _t(spark, d, "orders").filter(F.col("o_orderstatus") == "F")


def orders_in_range(spark, d):
    o = _t(spark, d, "orders")
    return o.filter((F.col("o_orderdate") >= ts_ntz("1996-01-01 00:00:00"))
                    & (F.col("o_orderdate") < ts_ntz("1996-04-01 00:00:00")))


def nested_field_filter(spark, d):
    """FLT-7 over stored nested documents: the filter is on a field of the struct column."""
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    docs = settle(o.join(c, o.o_custkey == c.c_custkey, "left").select(
        "o_orderkey", F.struct(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")).alias("user")
    ), "order_documents")
    return docs.filter(F.col("user.user_id") == 7).select(
        "o_orderkey", F.col("user.user_id").alias("user_id"), F.col("user.name").alias("user_name")
    )


def conditional_transform(spark, d):
    ev = _t(spark, d, "events").select("event_id", "event_type",
                                          F.col("value").cast("decimal(12,2)").alias("value"))
    return op.transform_if(ev, lambda df: {"value": F.lit(0).cast("decimal(12,2)")},
                           predicate=F.col("event_type") == "error", negate=True)


def _landed(spark, d, *names):
    """The mixed stream as it lands: stored rows in which the table name is data."""
    return settle(mixed.mixed_keys(spark, d, *names), "mixed")


def include_tables(spark, d):
    return op.include_tables(_landed(spark, d), mixed.SCENARIO_TABLES)


def include_schemas(spark, d):
    return op.include_schemas(_landed(spark, d, mixed.SQLSERVER_NAMES), ["data"])


def include_databases(spark, d):
    """FLT-2: events of one database; the two-part names belong to none of that name."""
    return op.include_databases(_landed(spark, d, mixed.SQLSERVER_NAMES), ["ecommerce"])


def capture_list_filter(spark, d):
    lst = spark.createDataFrame([(t,) for t in mixed.SCENARIO_TABLES], "table string")
    return op.capture_list_filter(_landed(spark, d), lst)


def capture_list_delta(spark, d):
    current = _landed(spark, d).select("table")
    new = spark.createDataFrame([(t,) for t in mixed.CONNECTOR_TABLES], "table string")
    return op.set_delta(current, new, "table")


def route_topics(spark, d):
    ev = op.include_tables(_landed(spark, d), mixed.SCENARIO_TABLES)
    return op.route(ev, mixed.TOPIC_PREFIX)


# --------------------------------------------------------------------------- joins


def absent_keys(spark, d):
    """JN-3: customers without an order (o_orderstatus null), and customers without an order of each status there is."""
    c = _t(spark, d, "customer").select("c_custkey", "c_name")
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    statuses = o.agg(F.collect_set("o_orderstatus")).scalar()
    each = c.select("c_custkey", "c_name", statuses.alias("statuses")).select("c_custkey", "c_name", F.explode("statuses").alias("o_orderstatus"))
    of_all = op.absent_in(c, o, ["c_custkey"]).withColumn("o_orderstatus", F.lit(None).cast("string"))
    return of_all.unionByName(op.absent_in(each, o, ["c_custkey", "o_orderstatus"]))


def exists_flag(spark, d):
    o = _t(spark, d, "orders")
    return op.exists_flags(o, {"has_f": F.col("o_orderstatus") == "F", "has_z": F.col("o_orderstatus") == "Z"})


def fk_lookup(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, d, "customer")
    n = _t(spark, d, "nation")
    x = op.lookup(o, c, [("o_custkey", "c_custkey")], ["c_name", "c_nationkey"])
    x = op.lookup(x, n, [("c_nationkey", "n_nationkey")], ["n_name"])
    return x.select("o_orderkey", "c_name", "n_name")


def strict_lookup(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    o = _t(spark, d, "orders")
    return op.strict_lookup(li, o, [("l_orderkey", "o_orderkey")], ["o_orderstatus"], what="order")


# --------------------------------------------------------------------------- aggregates


def max_or_one(spark, d):
    o = _t(spark, d, "orders")
    return o.agg(
        op.max_or_one(o, "o_orderkey", "max_key"),
        op.max_or_one(o, "o_orderkey", "max_key_empty", where=F.col("o_orderstatus") == "Z"),
    )


def table_counts(spark, d):
    return op.row_counts({name: _t(spark, d, name) for name in ALL_TABLES})


def capture_counters(spark, d):
    s = F.col("o_orderstatus")
    return op.counters(_t(spark, d, "orders"), {"n_f": s == "F", "n_o": s == "O", "n_p": s == "P"})


def first_by_name(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name")
    return op.first_by(p, F.col("p_name") == "cold widget", ["p_partkey"])


# --------------------------------------------------------------------------- catalog


def catalog_capture_candidates(spark, d):
    tables = catalog.tables_frame(spark, d)
    # The uniqueness proof (a shuffle of each key) runs only for tables that can qualify.
    indexes = catalog.indexes_frame(spark, d, catalog.untracked_in_schema("data"))
    found = op.capture_candidates(tables, catalog.schemas_frame(spark), indexes, "data")
    return found.select("object_id", "table_name", "schema_name", "row_count")


def catalog_tracked(spark, d):
    t = catalog.tables_frame(spark, d).join(catalog.schemas_frame(spark), "schema_id")
    return (t.filter(F.col("is_tracked_by_cdc") & (F.col("schema_name") == "data"))
            .orderBy("table_name").coalesce(1).select("table_name", "schema_name", "row_count", (F.monotonically_increasing_id() + 1).alias("place")))


def catalog_capture_status(spark, d):
    t = catalog.tables_frame(spark, d).join(catalog.schemas_frame(spark), "schema_id")
    return t.filter(F.col("schema_name") == "data").select(
        "table_name",
        F.when(F.col("is_tracked_by_cdc"), F.lit("Enabled")).otherwise(F.lit("Disabled")).alias("cdc_status"),
        "row_count",
    )


# --------------------------------------------------------------------------- checks


def check_not_null(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"))
    return op.not_null(o, ["priority"])


def check_unique(spark, d):
    return op.unique(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def check_foreign_key(spark, d):
    """CHK-3: orders, some of them pointed at customers that do not exist or at none, against the whole customer table."""
    k, c = F.col("o_orderkey") % 10, F.col("o_custkey")
    o = _t(spark, d, "orders").select("o_orderkey", F.when(k == 3, -c - 1).when(k != 4, c).alias("o_custkey"))
    return op.foreign_key(o, _t(spark, d, "customer"), [("o_custkey", "c_custkey")])


def check_length(spark, d):
    return op.max_length(_t(spark, d, "part").select("p_partkey", "p_name"), "p_name", 11)


def check_required(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    return op.required(o, "status")


def fill_defaults(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name")
    return op.fill_defaults(p, {"p_size": F.lit(0).cast("int"), "updated_at": ts_ntz(AS_OF)})


# --------------------------------------------------------------------------- mutations


def _changed_and_new(b):
    return b.filter((F.col("k") % 10).isin(1, 2) | (F.col("k") < 0)).select("k", "status", "total")


def upsert_partial(spark, d):
    a = v1(spark, d)
    return op.upsert(a, _changed_and_new(v2_from(a)), KEY, ["status"], defaults={"order_date": ts_ntz(AS_OF)})


def upsert_touch(spark, d):
    a = v1(spark, d)
    return op.upsert(a, _changed_and_new(v2_from(a)), KEY, ["status"], defaults={"order_date": ts_ntz(AS_OF)},
                     touch={"updated_at": ts_ntz(AS_OF_2)})


def doc_upsert(spark, d):
    p = _t(spark, d, "part")
    docs = p.select(F.col("p_partkey").alias("_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
                    F.col("p_size").alias("size"), ts_ntz(AS_OF).alias("created_at"))
    hit = p.filter(F.col("p_partkey") % 10 == 1)
    upd = hit.select(F.col("p_partkey").alias("_id"), F.concat("p_name", F.lit(" v2")).alias("name"),
                     F.array("p_brand", "p_type").alias("tags"))
    new = upd.withColumn("_id", -F.col("_id"))
    out = op.doc_upsert(docs, upd.unionByName(new), ["_id"], ["name", "tags"], {"created_at": ts_ntz(AS_OF_2)})
    return out.select("_id", "name", "brand", "size", F.array_join("tags", "|").alias("tags"), "created_at")


def insert_if_absent(spark, d):
    a = v1(spark, d)
    return op.insert_if_absent(a, v2_from(a), KEY)


def delete_keys(spark, d):
    a = v1(spark, d)
    return op.delete_keys(a, a.filter(F.col("k") % 10 == 0), KEY)


def cascade_delete(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    gone = _t(spark, d, "orders").filter(F.col("o_orderkey") % 10 == 0)
    return op.cascade_delete(li, gone, ["l_orderkey"], ["o_orderkey"])


def find_or_create_brands(spark, d):
    """MUT-4 with ids: brands of size-1 parts are the existing rows (ids 1..m in
    name order); every part resolves its brand to an existing or a new id."""
    p = _t(spark, d, "part")
    existing_names = p.filter(F.col("p_size") == 1).select(F.col("p_brand").alias("name")).distinct()
    target = op.assign_ids(existing_names, 1, ["name"], "id")
    src = p.select("p_partkey", F.col("p_brand").alias("name"))
    resolved, _ = op.find_or_create(target, src, ["name"], "id")
    return resolved.select("p_partkey", "name", "id")


def bucketed_upsert(spark, d):
    """MUT-1 on the bucket layout: V1 stored by key bucket, the batch rewrites only
    the buckets it touches; the table read back equals ``upsert_partial``."""
    a = v1(spark, d)
    path = shared_dir(spark, "bucketed_upsert")
    op.write_buckets(a, path, KEY, 64)
    op.upsert_buckets(spark, path, _changed_and_new(v2_from(a)), KEY, ["status"], 64,
                      defaults={"order_date": ts_ntz(AS_OF)})
    return op.read_buckets(spark, path).select(*a.columns)


def assign_ids(spark, d):
    """MUT-8 over every order, payload columns kept."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return op.assign_ids(o, op.next_id(o.select(F.col("o_custkey").alias("id")), "id"), ["o_orderkey"], "id")


def bucketed_delete(spark, d):
    """DER-1 on the bucket layout: a log that deletes the keys = 0 mod 10, then all others of the buckets it touches last."""
    a = v1(spark, d)
    path = shared_dir(spark, "bucketed_delete")
    op.write_buckets(a, path, ["k"], 16)
    log = op.capture(a, a.filter(F.col("k") % 10 != 0), TABLE, KEY, 1, versions.TS_1)
    op.apply_buckets(spark, path, log, KEY, 16)
    rest = op.read_buckets(spark, path).filter(F.col("k") % 10 != 5).drop("_bucket")
    op.apply_buckets(spark, path, op.capture(rest, rest.filter(F.lit(False)), TABLE, KEY, 2, versions.TS_2), KEY, 16)
    return op.read_buckets(spark, path).select(*a.columns)


# --------------------------------------------------------------------------- seeds
# The row source of each generator is a driver table's key (n = key + 1), so
# the amount of generated data follows the table.


def _ids(spark, d, table, key):
    return _t(spark, d, table).select((F.col(key) + 1).alias("n"))


def seed_products(spark, d):
    return seed.seed_products(_ids(spark, d, "part", "p_partkey"), AS_OF)


def seed_categories(spark, d):
    used = seed_products(spark, d).select(F.col("category_id").cast("bigint").alias("n")).distinct()
    return seed.seed_categories(used)


def seed_users(spark, d):
    return seed.seed_users(_ids(spark, d, "customer", "c_custkey"), AS_OF)


def seed_orders(spark, d):
    return seed.seed_orders(_ids(spark, d, "orders", "o_orderkey"), AS_OF)


def seed_order_items(spark, d):
    return seed.seed_order_items(_ids(spark, d, "orders", "o_orderkey"))


def seed_payments(spark, d):
    return seed.seed_payments(_ids(spark, d, "orders", "o_orderkey"), AS_OF)


def seed_inventory_logs(spark, d):
    return seed.seed_inventory_logs(_ids(spark, d, "events", "event_id"), AS_OF)


# --------------------------------------------------------------------------- capture


def snapshot_events(spark, d):
    ev = op.snapshot(v1(spark, d), TABLE, KEY, 1, versions.TS_1)
    return ev.select(F.col("key.k").alias("k"), "op", "seq", F.col("after.status").alias("status"),
                     F.col("after.total").alias("total"), F.col("after.order_date").alias("order_date"))


def capture_diff(spark, d):
    a = v1(spark, d)
    return flat_event(op.capture(a, v2_from(a), TABLE, KEY, 1, versions.TS_1))


def snapshot_then_log(spark, d):
    a = v1(spark, d)
    snap = op.snapshot(v2_from(a), TABLE, KEY, 1, versions.TS_1)
    ev = op.handoff(snap, change_log(spark, d), 1)
    return ev.select(F.col("key.k").alias("k"), "op", "seq", F.col("after.status").alias("status"),
                     F.col("after.total").alias("total"))


def net_changes(spark, d):
    ev = op.net_changes(change_log(spark, d))
    return ev.select(F.col("key.k").alias("k"), "op", "seq", F.col("before.status").alias("before_status"),
                     F.col("after.status").alias("after_status"))


def net_changes_events(spark, d):
    """CAP-4 over the events table read as a change log (key user_id, seq event_id):
    few keys, each with many events, so every key is a hot key."""
    ev = streams.events_as_changes(_t(spark, d, "events"))
    ev = ev.select(
        "table", "op", F.struct("user_id").alias("key"),
        F.when(F.col("op") != "c", F.struct("user_id", "event_type")).alias("before"),
        F.when(F.col("op") != "d", F.struct("user_id", "event_type")).alias("after"),
        "commit_ts", "seq",
    )
    net = op.net_changes(ev)
    return net.select(F.col("key.user_id").alias("user_id"), "op", "seq",
                      F.col("after.event_type").alias("last_type"))


def signal_snapshot(spark, d):
    """CAP-13: a signalled snapshot of V1 read in key chunks of 1000 while
    capture(V1, V2) runs; rows whose key changed in that window yield to the log."""
    a = v1(spark, d)
    window = op.capture(a, v2_from(a), TABLE, KEY, 2, versions.TS_1)
    snap = op.chunked_snapshot(a, TABLE, KEY, 1, 1000, window_events=window)
    return snap.select(F.col("key.k").alias("k"), "op", "seq", "chunk", F.col("after.status").alias("status"))


def route_mixed(spark, d):
    """Mixed-table stream: LOG and a copy named public.users travel with JSON
    payloads; routing public.orders back gives typed events."""
    log = change_log(spark, d)
    mixed_log = op.to_mixed(log).unionByName(op.to_mixed(log.withColumn("table", F.lit("public.users"))))
    back = op.from_mixed(mixed_log, TABLE, log.schema["key"].dataType, log.schema["after"].dataType)
    return flat_event(back)


def unwrap_after(spark, d):
    return op.unwrap(change_log(spark, d), deletes="drop")


def tombstones_on(spark, d):
    ev = op.tombstones(change_log(spark, d), on=True)
    return ev.select(F.col("key.k").alias("k"), "op", "seq", "is_tombstone",
                     F.col("after").isNull().alias("is_null_value"))


def tombstones_off(spark, d):
    ev = op.tombstones(change_log(spark, d), on=False)
    return ev.select(F.col("key.k").alias("k"), "op", "seq", "is_tombstone",
                     F.col("after").isNull().alias("is_null_value"))


def event_keys(spark, d):
    ev = op.event_key(change_log(spark, d))
    return ev.select(F.col("key.k").alias("k"), "op", "seq", "key_json")


def _value_struct():
    return F.struct(
        F.col("op"), F.col("seq").cast("string").alias("seq"), F.col("after.status").alias("status"),
        F.col("after.total").cast("string").alias("total"),
        F.col("after.order_date").cast("string").alias("order_date"),
    )


def kafka_records(spark, d):
    ev = op.route(change_log(spark, d), mixed.TOPIC_PREFIX)
    return to_kafka_string(ev, F.col("topic"), F.col("key"), _value_struct())


def kafka_tombstones(spark, d):
    """CAP-6 with SNK-4: a delete's record is followed by one with the key and no value."""
    ev = op.route(op.tombstones(change_log(spark, d), on=True), mixed.TOPIC_PREFIX)
    return to_kafka_string(ev, F.col("topic"), F.col("key"), _value_struct())


def json_schema_typed(spark, d):
    """SNK-6 with typed values: decimals, timestamps and integers in the converter's encodings."""
    o = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return o.select("k", json_with_schema(o, ["k", "total", "at"], "public.orders.Value").alias("value"))


def avro_names(spark, d):
    """SNK-7 on every order."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("order-key"), F.col("o_custkey").alias("2nd key"))
    return avro_safe_names(o)


def unwrap_rewrite(spark, d):
    """CAP-5, ``rewrite``: deletes keep their last row and are marked."""
    return op.unwrap(change_log(spark, d), deletes="rewrite").withColumnRenamed("__deleted", "is_deleted")


def unwrap_null(spark, d):
    """CAP-5, ``null``: deletes keep their key alone."""
    return op.unwrap(change_log(spark, d), deletes="null")


def replay_snapshot_log(spark, d):
    """DER-1 from nothing: a snapshot of V1 and the log, each delivered twice, into an empty table give V3."""
    a = v1(spark, d)
    log = op.snapshot(a, TABLE, KEY, 0, versions.TS_1).unionByName(change_log(spark, d))
    empty = a.filter(F.lit(False)).withColumn("_seq", F.lit(None).cast("bigint"))
    once = op.apply_changes(empty, log.unionByName(log), KEY, keep_markers=True)
    return op.apply_changes(once, log, KEY).select(*a.columns)


def chained_flow(spark, d):
    """FLT-9: include list, then routing, then keys, as one transform list."""
    steps = [lambda x: op.include_tables(x, [TABLE]), lambda x: op.route(x, mixed.TOPIC_PREFIX), op.event_key]
    return op.chain(change_log(spark, d), steps).select("topic", "key_json", "op", "seq")


def json_schema_payload(spark, d):
    a = v1(spark, d).select(
        F.col("k").cast("string").alias("k"), "status", F.col("total").cast("string").alias("total"),
        F.col("order_date").cast("string").alias("order_date"),
    )
    return a.select(F.col("k"), json_with_schema(a, ["k", "status", "total", "order_date"], "public.orders.Value")
                    .alias("value"))


def apply_changes(spark, d):
    return op.apply_changes(v1(spark, d), change_log(spark, d), KEY)


def change_feed(spark, d):
    """CAP-14, the flagship: snapshot, include list, net changes, routing, string records."""
    a = v1(spark, d)
    snap = op.snapshot(a, TABLE, KEY, 0, versions.TS_1)
    feed = snap.unionByName(op.net_changes(change_log(spark, d)))
    feed = op.include_tables(feed, mixed.SCENARIO_TABLES)
    feed = op.route(feed, mixed.TOPIC_PREFIX)
    return to_kafka_string(feed, F.col("topic"), F.col("key"), _value_struct())


# --------------------------------------------------------------------------- documents, totals, JSON


def _line_items(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     F.col("l_quantity").cast("decimal(12,2)").alias("quantity"),
                     F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))


def nest_items(spark, d):
    docs = op.nest(_line_items(spark, d), ["l_orderkey"], ["l_linenumber", "l_partkey", "quantity", "price"])
    return op.doc_summary(docs, ["l_orderkey"], "price")


def unnest_items(spark, d):
    docs = op.nest(_line_items(spark, d), ["l_orderkey"], ["l_linenumber", "l_partkey", "quantity", "price"])
    return op.unnest(docs, ["l_orderkey"])


def reconcile_totals(spark, d):
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    return op.reconcile_totals(o, li, "o_orderkey", "l_orderkey", F.col("o_totalprice").cast("decimal(12,2)"),
                               F.col("l_extendedprice").cast("decimal(12,2)"))


def parse_props(spark, d):
    ev = op.parse_json_object(_t(spark, d, "events").select("event_id", "props"), "props", "k int")
    return ev.select("event_id", F.col("props.k").alias("k"))


def parse_tags(spark, d):
    """DER-5: stored JSON array texts parsed into arrays, one row an element with its place; NULL and broken texts give none."""
    p = _t(spark, d, "part")
    k = F.col("p_partkey") % 10
    text = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("[not json")).when(k == 2, F.lit("[]")).otherwise(F.to_json(F.array("p_brand", "p_type", "p_name")))
    docs = settle(p.select("p_partkey", text.alias("tags")), "tags")
    return op.parse_json_array(docs, "tags").select("p_partkey", F.posexplode("tags").alias("place", "tag"))


def nested_arrays(spark, d):
    """DER-2: the items of every order document element by element, with their place in the array; at most 4 a document."""
    docs = op.nest(_line_items(spark, d), ["l_orderkey"], ["l_linenumber", "l_partkey", "quantity", "price"], max_items=4)
    each = docs.select("l_orderkey", "chunk", F.posexplode("items").alias("place", "item"))
    return each.select("l_orderkey", "chunk", "place", F.col("item.l_linenumber").alias("line"), F.col("item.l_partkey").alias("part"), F.col("item.price").alias("price"))


# --------------------------------------------------------------------------- streams


def stream_changes(spark, d):
    out = streams.stream_events_to_files(spark, d, shared_dir(spark, "stream_changes"))
    return spark.read.parquet(out).select("table", "op", "seq", "user_id", "event_type")


def stream_resumed(spark, d):
    """CAP-11: a stream stopped after its first half and started again from its checkpoint delivers every event once."""
    root = shared_dir(spark, "stream_resumed")
    ev = _t(spark, d, "events").select("event_id", "user_id", "event_type")
    for half in (0, 1):
        ev.filter(F.col("event_id") % 2 == half).write.parquet(f"{root}/in/{half}")
        stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        streams.run_available(stream, f"{root}/out", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/out")


def stream_dedup(spark, d):
    root = shared_dir(spark, "stream_dedup")
    a = streams.table_stream(spark, d, "events", TABLES["events"])
    b = streams.table_stream(spark, d, "events", TABLES["events"])
    s = streams.dedup_stream(a.unionByName(b), ["event_id"], "ts")
    # One state partition per core of the cluster (not the batch shuffle setting).
    streams.run_available(s.select("event_id", "user_id", "event_type", "ts"), f"{root}/out", f"{root}/_checkpoint",
                          state_partitions=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{root}/out").select("event_id", "user_id", "event_type")


def stream_feed(spark, d):
    """CAP-14 as a stream: LOG landed as files, streamed through include list,
    routing and string records with availableNow, settled output read back."""
    from changeflow.streaming.flow import start_flow

    root = shared_dir(spark, "stream_feed")
    log = change_log(spark, d)
    log.write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(log.schema).parquet(f"{root}/landing")
    start_flow(stream, mixed.SCENARIO_TABLES, [], mixed.TOPIC_PREFIX, _value_struct(), f"{root}/_checkpoint",
               f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in [
        scan_orders, stored_documents, key_gaps, written_tables, loaded_together, orders_by_status, orders_in_range, nested_field_filter, conditional_transform,
        include_tables, include_schemas, include_databases, capture_list_filter, capture_list_delta, route_topics,
        absent_keys, exists_flag, fk_lookup, strict_lookup,
        max_or_one, table_counts, capture_counters, first_by_name,
        catalog_capture_candidates, catalog_tracked, catalog_capture_status,
        check_not_null, check_unique, check_foreign_key, check_length, check_required, fill_defaults,
        upsert_partial, upsert_touch, doc_upsert, insert_if_absent, delete_keys, cascade_delete, assign_ids,
        find_or_create_brands, bucketed_upsert, bucketed_delete,
        seed_categories, seed_products, seed_users, seed_orders, seed_order_items, seed_payments,
        seed_inventory_logs,
        snapshot_events, capture_diff, snapshot_then_log, net_changes, net_changes_events, signal_snapshot,
        route_mixed, unwrap_after, tombstones_on,
        tombstones_off, event_keys, kafka_records, kafka_tombstones, json_schema_payload, json_schema_typed, avro_names,
        unwrap_rewrite, unwrap_null, apply_changes, replay_snapshot_log, chained_flow, change_feed,
        nest_items, unnest_items, nested_arrays, reconcile_totals, parse_props, parse_tags,
        stream_changes, stream_resumed, stream_dedup, stream_feed,
    ]
} | incremental.QUERIES

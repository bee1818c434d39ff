"""Queries of what is maintained from changes: windowed snapshots, digests, folded aggregates, cascades, lists with validity.

Each query has its DuckDB SQL beside it in ``ORACLE``; the versions and the log
are those of ``plans.versions``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow import operators as op
from changeflow.functions.partitioner import MULTIPLIER, SEED, partition_of
from changeflow.operators.cascade import CASCADE, RESTRICT, Reference
from changeflow.plans import mixed, versions
from changeflow.plans.oracle import W_LOG, W_V, _cap, _with, _VERSIONS
from changeflow.plans.versions import KEY, TABLE, change_log, flat_event, v1
from changeflow.schemas import SIGNAL_DOC, TABLES
from changeflow.session import settle, shared_dir
from changeflow.sources.tables import scan_table
from changeflow.streaming import changes as streams
from changeflow.streaming.position import run_feed
from changeflow.streaming.ranges import dedup_numbered

ORACLE: dict[str, str] = {}

# --------------------------------------------------------------------------- CAP-13

CHUNK = 1000
# Positions a version step spreads over, so that windows can cut it.
STEP = 10


def _positioned(log: DataFrame) -> DataFrame:
    return log.withColumn("seq", (F.col("seq") - 1) * STEP + F.pmod(F.col("key.k"), F.lit(STEP)) + 1)


def signal_windows(spark, d):
    """CAP-13: two signalled snapshots of V1 in chunks of 1000 keys, every chunk with its own watermarks over the log's positions."""
    signals = spark.createDataFrame([
        ("s1", "execute-snapshot", '{"data-collections": ["public.orders", "public.secret"], "type": "incremental"}'),
        ("s1", "execute-snapshot", '{"data-collections": ["public.orders", "public.secret"], "type": "incremental"}'),
        ("s2", "execute-snapshot", '{"data-collections": ["public.orders"], "type": "incremental"}'),
        ("s3", "log", '{"message": "no snapshot"}')], SIGNAL_DOC)
    listed = spark.createDataFrame([(t,) for t in mixed.SCENARIO_TABLES], "table string")
    requests = op.snapshot_requests(signals, listed)
    rows = v1(spark, d)
    chunks = rows.select(F.floor(F.col("k") / CHUNK).alias("chunk")).distinct()
    window = lambda s, n: chunks.select(
        F.lit(s).alias("signal_id"), F.lit(TABLE).alias("table"), "chunk", (F.col("chunk") * n % 7).alias("low"), (F.col("chunk") * n % 7 + 3 + F.col("chunk") % 5).alias("high"))
    windows = settle(reduce(DataFrame.unionByName, [window("s1", 1), window("s2", 3), window("s3", 5)]), "windows")
    snap = op.windowed_snapshot(rows, TABLE, KEY, CHUNK, requests, windows, _positioned(change_log(spark, d)))
    return snap.select("signal_id", "chunk", F.col("key.k").alias("k"), "op", "seq", F.col("after.status").alias("status"))


ORACLE["signal_windows"] = W_LOG + f"""
, pos AS (SELECT k, (seq - 1) * {STEP} + ((k % {STEP}) + {STEP}) % {STEP} + 1 AS p FROM log),
w AS (SELECT s.id AS signal_id, c.chunk, c.chunk * s.n % 7 AS low, c.chunk * s.n % 7 + 3 + c.chunk % 5 AS high
      FROM (SELECT DISTINCT CAST(floor(k / {CHUNK}) AS BIGINT) AS chunk FROM v1) c, (VALUES ('s1', 1), ('s2', 3)) s(id, n))
SELECT w.signal_id, w.chunk, v1.k, 'r' AS op, w.high AS seq, v1.status FROM v1 JOIN w ON CAST(floor(v1.k / {CHUNK}) AS BIGINT) = w.chunk
WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.k = v1.k AND pos.p > w.low AND pos.p <= w.high)"""

# --------------------------------------------------------------------------- CAP-2 by digests


def _sparse_change(base: DataFrame) -> DataFrame:
    """V1 with changes in one of 20 ranges of 100 keys only, and copies of some of its rows far below all other keys."""
    here = F.floor(F.col("k") / 100) % 20 == 7
    kept = base.filter(~(here & (F.col("k") % 5 == 1))).withColumn("status", F.when(here & (F.col("k") % 5 == 0), F.lit("Q")).otherwise(F.col("status")))
    return kept.unionByName(base.filter(here & (F.col("k") % 5 == 2)).withColumn("k", -F.col("k")))


def capture_digests(spark, d):
    """CAP-2: what changed between two versions that differ in few key ranges, by range digests."""
    a = v1(spark, d)
    return flat_event(op.capture_by_digest(a, _sparse_change(a), TABLE, KEY, 4, 100))


ORACLE["capture_digests"] = _with(_VERSIONS, """
sparse AS (SELECT k, CASE WHEN floor(k / 100) % 20 = 7 AND k % 5 = 0 THEN 'Q' ELSE status END AS status, total, order_date
           FROM v1 WHERE NOT (floor(k / 100) % 20 = 7 AND k % 5 = 1)
           UNION ALL SELECT -k, status, total, order_date FROM v1 WHERE floor(k / 100) % 20 = 7 AND k % 5 = 2)""") + (
    "SELECT k, op, seq, before_status, after_status, before_total, after_total FROM (" + _cap("v1", "sparse", 4) + ")")

# --------------------------------------------------------------------------- AG-2, AG-3, DER-3 from changes


def maintained_counts(spark, d):
    """AG-2, AG-3: rows and value a status, kept from V1 to V3 by the log alone; the second batch comes twice and with the first again."""
    cents = {"total_cents": lambda r: (r["total"] * 100).cast("bigint")}
    log = settle(change_log(spark, d), "log")
    stored = op.aggregate_rows(v1(spark, d), ["status"], cents)
    first = op.fold_changes(stored, log.filter("seq = 1"), ["status"], cents, 0)
    return op.fold_changes(settle(first, "counts"), log.unionByName(log.filter("seq = 2")), ["status"], cents, 1)


ORACLE["maintained_counts"] = W_V + "SELECT status, COUNT(*) AS n, CAST(SUM(total * 100) AS BIGINT) AS total_cents FROM v3 GROUP BY status"


def _lines(spark, d) -> DataFrame:
    """Items by (order, line number); the stored pairs are not unique, so equal ones are one item."""
    li = scan_table(spark, d, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return li.groupBy("l_orderkey", F.col("l_linenumber").cast("int").alias("line")).agg(F.sum(cents).alias("cents"))


def _lines_2(lines: DataFrame) -> DataFrame:
    kept = lines.filter(~((F.col("l_orderkey") % 7 == 0) & (F.col("line") == 1))).withColumn("cents", F.when(F.col("line") == 2, F.col("cents") * 2).otherwise(F.col("cents")))
    return kept.unionByName(lines.filter((F.col("l_orderkey") % 5 == 0) & (F.col("line") == 1)).withColumn("line", F.col("line") + 100))


def maintained_order_totals(spark, d):
    """DER-3: each order's number of items and total, kept from changes of the items; orders that lose their last item go."""
    before = _lines(spark, d)
    total = {"total_cents": lambda r: r["cents"]}
    events = op.capture(before, _lines_2(before), "public.order_items", ["l_orderkey", "line"], 1)
    return op.fold_changes(op.aggregate_rows(before, ["l_orderkey"], total), events, ["l_orderkey"], total)


ORACLE["maintained_order_totals"] = """
WITH l AS (SELECT l_orderkey, l_linenumber AS line, SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY ALL),
l2 AS (SELECT l_orderkey, CASE WHEN line = 2 THEN cents * 2 ELSE cents END AS cents FROM l WHERE NOT (l_orderkey % 7 = 0 AND line = 1)
       UNION ALL SELECT l_orderkey, cents FROM l WHERE l_orderkey % 5 = 0 AND line = 1)
SELECT l_orderkey, COUNT(*) AS n, CAST(SUM(cents) AS BIGINT) AS total_cents FROM l2 GROUP BY l_orderkey"""

# --------------------------------------------------------------------------- MUT-6 over the graph

_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
         "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_suppkey"]}
_REFERENCES = [
    Reference("nation", ["n_regionkey"], "region", CASCADE), Reference("customer", ["c_nationkey"], "nation", CASCADE),
    Reference("supplier", ["s_nationkey"], "nation", CASCADE), Reference("orders", ["o_custkey"], "customer", CASCADE),
    Reference("lineitem", ["l_orderkey"], "orders", CASCADE), Reference("lineitem", ["l_suppkey"], "supplier", CASCADE),
    Reference("lineitem", ["l_partkey"], "part", RESTRICT),
]


def cascade_graph(spark, d):
    """MUT-6: region 1, every tenth customer and the parts without items deleted; what is left of all tables below them."""
    tables = {t: scan_table(spark, d, t) for t in _KEYS}
    unused = tables["part"].join(tables["lineitem"], F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    gone = {"region": tables["region"].filter("r_regionkey = 1"), "customer": tables["customer"].filter("c_custkey % 10 = 0"), "part": unused}
    left = op.delete_cascading(tables, _KEYS, _REFERENCES, gone)
    flat = lambda t: left[t].select(F.lit(t).alias("table"), F.col(_KEYS[t][0]).cast("bigint").alias("k1"), (F.col(_KEYS[t][1]) if len(_KEYS[t]) > 1 else F.lit(None)).cast("bigint").alias("k2"))
    return reduce(DataFrame.unionByName, [flat(t) for t in _KEYS])


ORACLE["cascade_graph"] = """
WITH r AS (SELECT * FROM region WHERE r_regionkey <> 1), n AS (SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM r)),
c AS (SELECT * FROM customer WHERE c_custkey % 10 <> 0 AND c_nationkey IN (SELECT n_nationkey FROM n)),
s AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) AND l_suppkey IN (SELECT s_suppkey FROM s))
SELECT 'region' AS "table", CAST(r_regionkey AS BIGINT) AS k1, CAST(NULL AS BIGINT) AS k2 FROM r
UNION ALL SELECT 'nation', n_nationkey, NULL FROM n UNION ALL SELECT 'customer', c_custkey, NULL FROM c
UNION ALL SELECT 'supplier', s_suppkey, NULL FROM s UNION ALL SELECT 'orders', o_orderkey, NULL FROM o
UNION ALL SELECT 'part', p_partkey, NULL FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber FROM l"""

# --------------------------------------------------------------------------- CAP-10 with validity

_LISTS = [(5, ["public.users", "public.orders"]), (12, mixed.CONNECTOR_TABLES), (20, []), (25, ["public.products"])]


def capture_list_versions(spark, d):
    """CAP-10: the stored list replaced three times inside the log, once by an empty list; each event judged by the list of its position."""
    events = settle(mixed.mixed_keys(spark, d), "mixed").withColumn("seq", F.col("key") % 30)
    lists = None
    for seq, names in _LISTS:
        lists = op.replace_capture_list(lists, spark.createDataFrame([(t,) for t in names], "table string"), seq)
    return op.capture_list_asof(events, settle(lists, "lists")).select("table", "key", "seq")


ORACLE["capture_list_versions"] = """
WITH mixed AS (SELECT 'public.orders' AS "table", o_orderkey AS key FROM orders UNION ALL SELECT 'public.users', c_custkey FROM customer
               UNION ALL SELECT 'public.products', p_partkey FROM part),
e AS (SELECT *, key % 30 AS seq FROM mixed), lists AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({seq}, {repr(t)})" for seq, names in _LISTS for t in names) + """) t(from_seq, name)),
starts AS (SELECT * FROM (VALUES """ + ", ".join(f"({seq})" for seq, _ in _LISTS) + """) t(from_seq))
SELECT "table", key, seq FROM e WHERE "table" IN (SELECT name FROM lists WHERE lists.from_seq = (SELECT MAX(from_seq) FROM starts WHERE starts.from_seq <= e.seq))"""

# --------------------------------------------------------------------------- CAP-4 over several intervals

_INTERVALS = [(0, 6), (3, 14), (0, 20)]


def net_changes_windows(spark, d):
    """CAP-4: net changes of three overlapping intervals of the log's positions, by one pass over it."""
    net = op.net_changes_intervals(_positioned(change_log(spark, d)), _INTERVALS)
    return net.select("low", "high", F.col("key.k").alias("k"), "op", "seq", F.col("before.status").alias("before_status"), F.col("after.status").alias("after_status"))


ORACLE["net_changes_windows"] = W_LOG + f"""
, pos AS (SELECT *, (seq - 1) * {STEP} + ((k % {STEP}) + {STEP}) % {STEP} + 1 AS p FROM log),
i AS (SELECT CAST(a AS BIGINT) AS low, CAST(b AS BIGINT) AS high FROM (VALUES {", ".join(map(str, _INTERVALS))}) t(a, b)),
ends AS (SELECT low, high, k, MIN(p) AS mn, MAX(p) AS mx FROM pos JOIN i ON p > low AND p <= high GROUP BY ALL),
n AS (SELECT e.low, e.high, e.k, e.mx AS seq, f.before_status, l.after_status,
             CASE WHEN f.op = 'c' AND l.op <> 'd' THEN 'c' WHEN f.op <> 'c' AND l.op <> 'd' THEN 'u' WHEN f.op <> 'c' AND l.op = 'd' THEN 'd' END AS op
      FROM ends e JOIN pos f ON f.k = e.k AND f.p = e.mn JOIN pos l ON l.k = e.k AND l.p = e.mx)
SELECT low, high, k, op, seq, CASE WHEN op <> 'c' THEN before_status END AS before_status, CASE WHEN op <> 'd' THEN after_status END AS after_status FROM n WHERE op IS NOT NULL"""

# --------------------------------------------------------------------------- SNK-4, CAP-8: partitions and offsets

PARTITIONS = 12


def keyed_partitions(spark, d):
    """SNK-4, CAP-8: the log's events in the partitions of a keyed log, numbered in each in the order of their positions."""
    ev = op.route(op.event_key(change_log(spark, d)), mixed.TOPIC_PREFIX)
    ev = ev.select("topic", "key_json", F.col("key.k").alias("k"), "op", "seq").withColumn("partition", partition_of(F.col("key_json"), PARTITIONS))
    return op.number_within(ev, ["topic", "partition"], ["seq", "k"], "offset").drop("key_json")


ORACLE["keyed_partitions"] = W_LOG + f"""
, bytes AS (SELECT k, op, seq, list_transform(string_split('{{"k":' || k || '}}', ''), lambda x: ascii(x)::BIGINT) AS b FROM log),
mixed4 AS (SELECT *, len(b) // 4 AS w, list_reduce(list_concat([xor(len(b), {SEED})], list_transform(range(len(b) // 4),
             lambda i: b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216)),
             lambda h, x: xor((h * {MULTIPLIER}) & 4294967295, (xor((x * {MULTIPLIER}) & 4294967295, ((x * {MULTIPLIER}) & 4294967295) >> 24) * {MULTIPLIER}) & 4294967295)) AS h FROM bytes),
tailed AS (SELECT *, CASE WHEN len(b) % 4 = 0 THEN h ELSE (xor(h, b[4 * w + 1] + coalesce(b[4 * w + 2], 0) * 256 + coalesce(b[4 * w + 3], 0) * 65536) * {MULTIPLIER}) & 4294967295 END AS t FROM mixed4),
folded AS (SELECT *, (xor(t, t >> 13) * {MULTIPLIER}) & 4294967295 AS f FROM tailed),
placed AS (SELECT 'ecomm-postgres.public.orders' AS topic, k, op, seq, CAST((xor(f, f >> 15) & 2147483647) % {PARTITIONS} AS INTEGER) AS partition FROM folded)
SELECT *, row_number() OVER (PARTITION BY partition ORDER BY seq, k) - 1 AS "offset" FROM placed"""

# --------------------------------------------------------------------------- CHK-3 of a batch


def check_foreign_key_batch(spark, d):
    """CHK-3: the orders of one year, some pointed at no customer, against the whole customer table through a filter of their references."""
    k, c = F.col("o_orderkey") % 10, F.col("o_custkey")
    o = scan_table(spark, d, "orders").filter(F.year("o_orderdate") == 1996)
    batch = o.select("o_orderkey", F.when(k == 3, -c - 1).when(k != 4, c).alias("o_custkey"))
    return op.foreign_key_batch(batch, scan_table(spark, d, "customer"), [("o_custkey", "c_custkey")])


ORACLE["check_foreign_key_batch"] = (
    "SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN -o_custkey - 1 WHEN o_orderkey % 10 <> 4 THEN o_custkey END AS o_custkey "
    "FROM orders WHERE year(o_orderdate) = 1996) o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey)")

# --------------------------------------------------------------------------- streams

SHARDS = 64


def stream_dedup_ranges(spark, d):
    """DER-4: every event delivered twice, once each out; the state keeps ranges of the numbers seen in each of 64 shards."""
    root = shared_dir(spark, "dedup_ranges")
    s = streams.table_stream(spark, d, "events", TABLES["events"])
    s = s.select("event_id", "user_id", "event_type", F.pmod("event_id", F.lit(SHARDS)).alias("shard"), F.call_function("div", "event_id", F.lit(SHARDS)).alias("number"))
    streams.run_available(dedup_numbered(s.unionByName(s), "shard", "number"), f"{root}/out", f"{root}/_checkpoint", state_partitions=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{root}/out").select("event_id", "user_id", "event_type")


ORACLE["stream_dedup_ranges"] = "SELECT DISTINCT event_id, user_id, event_type FROM events"


def stream_position_dropped(spark, d):
    """CAP-11: a feed of V1 stopped between the log's halves and resumed, then begun anew from V2 with its position dropped."""
    root = shared_dir(spark, "position")
    log, base = change_log(spark, d), v1(spark, d)
    schema = log.schema
    feed = lambda rows, at, name: run_feed(op.snapshot(rows, TABLE, KEY, at), spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/landing"), f"{root}/{name}")
    for half in (1, 2):
        log.filter(F.col("seq") == half).write.parquet(f"{root}/landing/{half}")
        first = feed(versions.v2_from(base) if half == 2 else base, half - 1, "first")
    second = feed(versions.v2_from(base), 1, "second")
    flat = lambda df, n: df.select(F.lit(n).alias("start"), F.col("key.k").alias("k"), "op", "seq", F.col("after.status").alias("status"))
    return flat(first, 1).unionByName(flat(second, 2))


ORACLE["stream_position_dropped"] = W_LOG + """
SELECT 1 AS start, k, 'r' AS op, CAST(0 AS BIGINT) AS seq, status FROM v1 UNION ALL SELECT 1, k, op, seq, after_status FROM log
UNION ALL SELECT 2, k, 'r', 1, status FROM v2 UNION ALL SELECT 2, k, op, seq, after_status FROM log WHERE seq = 2"""

QUERIES = {f.__name__: f for f in [
    signal_windows, capture_digests, maintained_counts, maintained_order_totals, cascade_graph, capture_list_versions,
    net_changes_windows, keyed_partitions, check_foreign_key_batch, stream_dedup_ranges, stream_position_dropped,
]}

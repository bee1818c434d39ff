"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans from the same query definitions, over
the driver's views (``orders``, ``lineitem``, ...). Column names and types
match the Spark outputs one for one.
"""

from __future__ import annotations

# --------------------------------------------------------------------------- versions and log

_VERSIONS = """
v1 AS (SELECT o_orderkey AS k, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(12,2)) AS total,
              o_orderdate AS order_date FROM orders),
v2 AS (SELECT k, CASE WHEN k % 10 IN (1, 2) THEN 'X' ELSE status END AS status, total, order_date
       FROM v1 WHERE k % 10 <> 0
       UNION ALL
       SELECT -k, status, total, order_date FROM v1 WHERE k % 10 = 3),
v3 AS (SELECT k, CASE WHEN k % 10 = 1 THEN 'Y' ELSE status END AS status, total, order_date
       FROM v1 WHERE k % 10 <> 5
       UNION ALL
       SELECT -k, 'Z', total, order_date FROM v1 WHERE k % 20 = 3)
"""


def _cap(a: str, b: str, seq: int) -> str:
    return f"""
SELECT COALESCE(n.k, o.k) AS k,
       CASE WHEN o.k IS NULL THEN 'c' WHEN n.k IS NULL THEN 'd' ELSE 'u' END AS op,
       CAST({seq} AS BIGINT) AS seq,
       o.status AS before_status, n.status AS after_status,
       o.total AS before_total, n.total AS after_total,
       o.order_date AS before_order_date, n.order_date AS after_order_date
FROM {a} o FULL OUTER JOIN {b} n ON o.k = n.k
WHERE o.k IS NULL OR n.k IS NULL
   OR o.status IS DISTINCT FROM n.status OR o.total IS DISTINCT FROM n.total
   OR o.order_date IS DISTINCT FROM n.order_date"""


_LOG = f"log AS ({_cap('v1', 'v2', 1)}\nUNION ALL{_cap('v2', 'v3', 2)})"

_NET = """
net0 AS (
  SELECT g.k,
         CASE WHEN f.op = 'c' AND l.op <> 'd' THEN 'c'
              WHEN f.op <> 'c' AND l.op <> 'd' THEN 'u'
              WHEN f.op <> 'c' AND l.op = 'd' THEN 'd' END AS op,
         g.mx AS seq, f.before_status AS f_before_status, l.after_status AS l_after_status,
         l.after_total AS l_after_total, l.after_order_date AS l_after_order_date
  FROM (SELECT k, MIN(seq) AS mn, MAX(seq) AS mx FROM log GROUP BY k) g
  JOIN log f ON f.k = g.k AND f.seq = g.mn
  JOIN log l ON l.k = g.k AND l.seq = g.mx),
net AS (
  SELECT k, op, seq,
         CASE WHEN op <> 'c' THEN f_before_status END AS before_status,
         CASE WHEN op <> 'd' THEN l_after_status END AS after_status,
         CASE WHEN op <> 'd' THEN l_after_total END AS after_total,
         CASE WHEN op <> 'd' THEN l_after_order_date END AS after_order_date
  FROM net0 WHERE op IS NOT NULL)
"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


W_V = _with(_VERSIONS)
W_LOG = _with(_VERSIONS, _LOG)
W_NET = _with(_VERSIONS, _LOG, _NET)

# --------------------------------------------------------------------------- mixed stream

_MIXED = """
mixed AS (SELECT 'public.orders' AS "table", o_orderkey AS key FROM orders
          UNION ALL SELECT 'public.users', c_custkey FROM customer
          UNION ALL SELECT 'public.products', p_partkey FROM part)
"""
_MIXED_SQLSERVER = """
mixed AS (SELECT 'ecommerce.data.orders' AS "table", o_orderkey AS key FROM orders
          UNION ALL SELECT 'public.users', c_custkey FROM customer
          UNION ALL SELECT 'ecommerce.data.products', p_partkey FROM part)
"""
_SCENARIO = "('public.users', 'public.orders')"
_CONNECTOR = ("('public.categories'), ('public.products'), ('public.users'), ('public.orders'), "
              "('public.order_items'), ('public.payments'), ('public.inventory_logs')")

# --------------------------------------------------------------------------- catalog

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
           "embeddings", "pages", "benchmark", "labels", "conversations"]
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
         "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey, l_linenumber",
         "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id",
         "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id, turn"}
_DATA = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem"}
_TRACKED = {"customer", "orders"}


def _catalog_ctes() -> str:
    rows, pks = [], []
    for i, t in enumerate(_TABLES, start=1):
        rows.append(f"SELECT {i} AS object_id, '{t}' AS table_name, {1 if t in _DATA else 2} AS schema_id, "
                    f"{'TRUE' if t in _TRACKED else 'FALSE'} AS is_tracked_by_cdc, "
                    f"(SELECT COUNT(*) FROM {t}) AS row_count")
        keys = _KEYS[t]
        not_null = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
        pks.append(f"SELECT {i} AS object_id, (SELECT COUNT(*) FROM (SELECT DISTINCT {keys} FROM {t} "
                   f"WHERE {not_null})) = (SELECT COUNT(*) FROM {t}) AS is_primary_key")
    return (
        "cat_tables AS (" + "\nUNION ALL ".join(rows) + "),\n"
        "cat_schemas AS (SELECT * FROM (VALUES (1, 'data'), (2, 'other')) s(schema_id, schema_name)),\n"
        "cat_pk AS (" + "\nUNION ALL ".join(pks) + ")"
    )


# --------------------------------------------------------------------------- seeds


def _u(salt: str) -> str:
    return f"CAST('0x' || substr(md5(CAST(n AS VARCHAR) || ':{salt}'), 1, 8) AS BIGINT)"


def _below(salt: str, k: int) -> str:
    return f"(({_u(salt)} * {k}) >> 32)"


def _cents(salt: str, lo: int, span: int) -> str:
    return f"CAST(CAST({lo * 100} + (({_u(salt)} * {span * 100} + 2147483648) >> 32) AS DOUBLE) / 100.0 AS DECIMAL(10,2))"


_AS_OF = "TIMESTAMP '2026-01-01 00:00:00'"
_AS_OF_2 = "TIMESTAMP '2026-02-01 00:00:00'"

_SEED_PRODUCTS = f"""
SELECT CAST(n AS INTEGER) AS product_id, 'Product ' || CAST(n AS VARCHAR) AS name,
       {_cents('price', 10, 90)} AS price,
       CAST({_below('stock_quantity', 101)} AS INTEGER) AS stock_quantity,
       CAST({_below('category_id', 10)} + 1 AS INTEGER) AS category_id,
       {_AS_OF} AS updated_at
FROM (SELECT p_partkey + 1 AS n FROM part)"""

# --------------------------------------------------------------------------- value JSON

_VALUE_LOG = ("CAST(json_object('op', op, 'seq', CAST(seq AS VARCHAR), 'status', after_status, "
              "'total', CAST(after_total AS VARCHAR), 'order_date', CAST(after_order_date AS VARCHAR)) AS VARCHAR)")

# Written out by hand: the converter's schema of four nullable strings.
_PAYLOAD_SCHEMA = (
    '{"type":"struct","fields":[{"type":"string","optional":true,"field":"k"},{"type":"string","optional":true,"field":"status"},'
    '{"type":"string","optional":true,"field":"total"},{"type":"string","optional":true,"field":"order_date"}],'
    '"optional":false,"name":"public.orders.Value"}'
)


_TYPED_SCHEMA = (
    '{"type":"struct","fields":[{"type":"int64","optional":true,"field":"k"},'
    '{"type":"bytes","optional":true,"name":"org.apache.kafka.connect.data.Decimal","version":1,"parameters":{"scale":"2"},"field":"total"},'
    '{"type":"int64","optional":true,"name":"org.apache.kafka.connect.data.Timestamp","version":1,"field":"at"}],'
    '"optional":false,"name":"public.orders.Value"}'
)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_orders"] = "SELECT * FROM orders"
    q["stored_documents"] = "SELECT o_orderkey AS _id, o_custkey AS user_id, o_orderstatus AS status FROM orders"
    q["key_gaps"] = ("WITH n AS (SELECT unnest(generate_series((SELECT MIN(o_orderkey) FROM orders), (SELECT MAX(o_orderkey) FROM orders))) AS k), "
                     "s AS (SELECT o_orderstatus, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus) "
                     "SELECT CAST(NULL AS VARCHAR) AS o_orderstatus, k AS o_orderkey FROM n WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = k) "
                     "UNION ALL SELECT s.o_orderstatus, k FROM s JOIN n ON k BETWEEN lo AND hi "
                     "WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = k AND o.o_orderstatus = s.o_orderstatus)")
    q["written_tables"] = W_V + "SELECT * FROM v1"
    q["loaded_together"] = W_V + ("SELECT 'orders' AS name, k, status AS value FROM v2 "
                                  "UNION ALL SELECT 'users', c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
    q["stream_resumed"] = "SELECT event_id, user_id, event_type FROM events"
    q["orders_by_status"] = "SELECT * FROM orders WHERE o_orderstatus = 'F'"
    q["orders_in_range"] = ("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' "
                            "AND o_orderdate < TIMESTAMP '1996-04-01 00:00:00'")
    q["nested_field_filter"] = ("SELECT o.o_orderkey, c.c_custkey AS user_id, c.c_name AS user_name FROM orders o "
                                "LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_custkey = 7")
    q["conditional_transform"] = (
        "SELECT event_id, event_type, CASE WHEN COALESCE(event_type = 'error', FALSE) <> TRUE "
        "THEN CAST(0 AS DECIMAL(12,2)) ELSE CAST(value AS DECIMAL(12,2)) END AS value FROM events")
    q["include_tables"] = _with(_MIXED) + f'SELECT "table", key FROM mixed WHERE "table" IN {_SCENARIO}'
    q["include_schemas"] = (_with(_MIXED_SQLSERVER)
                            + "SELECT \"table\", key FROM mixed WHERE string_split(\"table\", '.')[-2] = 'data'")
    q["capture_list_filter"] = q["include_tables"]
    q["capture_list_delta"] = _with(_MIXED, f'lst AS (SELECT * FROM (VALUES {_CONNECTOR}) v("table"))') + """
SELECT "table", 'added' AS change FROM lst WHERE "table" NOT IN (SELECT DISTINCT "table" FROM mixed)
UNION ALL
SELECT DISTINCT "table", 'removed' AS change FROM mixed WHERE "table" NOT IN (SELECT "table" FROM lst)"""
    q["route_topics"] = _with(_MIXED) + (
        f"SELECT \"table\", key, 'ecomm-postgres.' || \"table\" AS topic FROM mixed WHERE \"table\" IN {_SCENARIO}")

    q["absent_keys"] = ("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS o_orderstatus FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) "
                        "UNION ALL SELECT c_custkey, c_name, s.o_orderstatus FROM customer, (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL) s "
                        "WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = s.o_orderstatus)")
    q["exists_flag"] = ("SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F') AS has_f, "
                        "EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'Z') AS has_z")
    q["fk_lookup"] = ("SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o "
                      "LEFT JOIN customer c ON o.o_custkey = c.c_custkey "
                      "LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
    q["strict_lookup"] = ("SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l "
                          "LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey")

    q["max_or_one"] = ("SELECT COALESCE(MAX(o_orderkey), 1) AS max_key, "
                       "COALESCE(MAX(CASE WHEN o_orderstatus = 'Z' THEN o_orderkey END), 1) AS max_key_empty "
                       "FROM orders")
    q["table_counts"] = "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in _TABLES)
    q["capture_counters"] = ("SELECT CAST(COUNT_IF(o_orderstatus = 'F') AS BIGINT) AS n_f, "
                             "CAST(COUNT_IF(o_orderstatus = 'O') AS BIGINT) AS n_o, "
                             "CAST(COUNT_IF(o_orderstatus = 'P') AS BIGINT) AS n_p FROM orders")
    q["first_by_name"] = ("SELECT p_partkey, p_name FROM part WHERE p_name = 'cold widget' "
                          "ORDER BY p_partkey LIMIT 1")

    cat = "WITH " + _catalog_ctes() + "\n"
    q["catalog_capture_candidates"] = cat + """
SELECT t.object_id, t.table_name, s.schema_name, t.row_count
FROM cat_tables t JOIN cat_schemas s ON t.schema_id = s.schema_id
WHERE s.schema_name = 'data'
  AND EXISTS (SELECT 1 FROM cat_pk p WHERE p.object_id = t.object_id AND p.is_primary_key)
  AND NOT t.is_tracked_by_cdc"""
    q["catalog_tracked"] = cat + """
SELECT t.table_name, s.schema_name, t.row_count, row_number() OVER (ORDER BY t.table_name) AS place
FROM cat_tables t JOIN cat_schemas s ON t.schema_id = s.schema_id
WHERE t.is_tracked_by_cdc AND s.schema_name = 'data' ORDER BY t.table_name"""
    q["catalog_capture_status"] = cat + """
SELECT t.table_name, CASE WHEN t.is_tracked_by_cdc THEN 'Enabled' ELSE 'Disabled' END AS cdc_status, t.row_count
FROM cat_tables t JOIN cat_schemas s ON t.schema_id = s.schema_id WHERE s.schema_name = 'data'"""

    q["check_not_null"] = ("SELECT o_orderkey, NULLIF(o_orderpriority, '5-LOW') AS priority FROM orders "
                           "WHERE NULLIF(o_orderpriority, '5-LOW') IS NULL")
    q["check_unique"] = ("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem "
                         "GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1")
    q["check_foreign_key"] = ("SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN -o_custkey - 1 WHEN o_orderkey % 10 <> 4 THEN o_custkey END "
                              "AS o_custkey FROM orders) o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey)")
    q["check_length"] = "SELECT p_partkey, p_name FROM part WHERE length(p_name) > 11"
    q["check_required"] = ("SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status FROM orders "
                           "WHERE COALESCE(NULLIF(o_orderstatus, 'P'), '') = ''")
    q["fill_defaults"] = f"SELECT p_partkey, p_name, CAST(0 AS INTEGER) AS p_size, {_AS_OF} AS updated_at FROM part"

    src = "src AS (SELECT k, status, total FROM v2 WHERE k % 10 IN (1, 2) OR k < 0)"
    upsert_cols = f"""
SELECT COALESCE(t.k, s.k) AS k,
       CASE WHEN t.k IS NOT NULL AND s.k IS NOT NULL THEN s.status WHEN t.k IS NOT NULL THEN t.status
            ELSE s.status END AS status,
       CASE WHEN t.k IS NOT NULL THEN t.total ELSE s.total END AS total,
       CASE WHEN t.k IS NOT NULL THEN t.order_date ELSE {_AS_OF} END AS order_date"""
    q["upsert_partial"] = _with(_VERSIONS, src) + upsert_cols + "\nFROM v1 t FULL OUTER JOIN src s ON t.k = s.k"
    q["upsert_touch"] = (_with(_VERSIONS, src) + upsert_cols
                         + f",\n       CASE WHEN t.k IS NOT NULL AND s.k IS NOT NULL THEN {_AS_OF_2} END AS updated_at"
                         + "\nFROM v1 t FULL OUTER JOIN src s ON t.k = s.k")
    q["doc_upsert"] = f"""
SELECT p_partkey AS _id, CASE WHEN p_partkey % 10 = 1 THEN p_name || ' v2' ELSE p_name END AS name,
       p_brand AS brand, p_size AS size,
       CASE WHEN p_partkey % 10 = 1 THEN p_brand || '|' || p_type END AS tags, {_AS_OF} AS created_at
FROM part
UNION ALL
SELECT -p_partkey, p_name || ' v2', NULL, NULL, p_brand || '|' || p_type, {_AS_OF_2}
FROM part WHERE p_partkey % 10 = 1"""
    q["insert_if_absent"] = W_V + ("SELECT * FROM v1 UNION ALL SELECT * FROM v2 "
                                   "WHERE NOT EXISTS (SELECT 1 FROM v1 WHERE v1.k = v2.k)")
    q["delete_keys"] = W_V + "SELECT * FROM v1 WHERE k % 10 <> 0"
    q["cascade_delete"] = ("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS "
                           "(SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 10 = 0)")
    q["assign_ids"] = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST((SELECT COALESCE(MAX(o_custkey), 1) FROM orders) "
                       "+ row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS id FROM orders")
    q["bucketed_delete"] = W_V + "SELECT * FROM v1 WHERE k % 10 = 5"

    q["find_or_create_brands"] = """
WITH t AS (SELECT name, CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS id
           FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_size = 1)),
fresh AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand NOT IN (SELECT name FROM t)),
c AS (SELECT name, CAST((SELECT COALESCE(MAX(id), 1) FROM t) + row_number() OVER (ORDER BY name) AS BIGINT) AS id
      FROM fresh),
ids AS (SELECT * FROM t UNION ALL SELECT * FROM c)
SELECT p.p_partkey, p.p_brand AS name, ids.id FROM part p LEFT JOIN ids ON p.p_brand = ids.name"""
    q["bucketed_upsert"] = q["upsert_partial"]
    q["seed_products"] = _SEED_PRODUCTS
    q["seed_categories"] = f"""
SELECT CAST(n AS INTEGER) AS category_id, 'Category ' || CAST(n AS VARCHAR) AS name,
       'Description for Category ' || CAST(n AS VARCHAR) AS description
FROM (SELECT DISTINCT CAST(category_id AS BIGINT) AS n FROM ({_SEED_PRODUCTS}))"""
    q["seed_users"] = f"""
SELECT CAST(n AS INTEGER) AS user_id, 'user_' || CAST(n AS VARCHAR) AS username,
       'user_' || CAST(n AS VARCHAR) || '@example.com' AS email,
       {_AS_OF} - to_minutes(n) AS created_at, {_AS_OF} - to_minutes(n) AS last_login
FROM (SELECT c_custkey + 1 AS n FROM customer)"""
    q["seed_orders"] = f"""
SELECT CAST(n AS INTEGER) AS order_id, CAST({_below('user_id', 1000)} + 1 AS INTEGER) AS user_id,
       {_AS_OF} AS order_date,
       CASE {_below('status', 3)} WHEN 0 THEN 'pending' WHEN 1 THEN 'shipped' ELSE 'cancelled' END AS status,
       {_cents('total_amount', 100, 900)} AS total_amount
FROM (SELECT o_orderkey + 1 AS n FROM orders)"""
    q["seed_order_items"] = f"""
SELECT CAST(n AS INTEGER) AS order_item_id, CAST({_below('order_id', 1000)} + 1 AS INTEGER) AS order_id,
       CAST({_below('product_id', 1000)} + 1 AS INTEGER) AS product_id,
       CAST({_below('quantity', 5)} + 1 AS INTEGER) AS quantity,
       {_cents('unit_price', 10, 90)} AS unit_price
FROM (SELECT o_orderkey + 1 AS n FROM orders)"""
    q["seed_payments"] = f"""
SELECT CAST(n AS INTEGER) AS payment_id, CAST(n AS INTEGER) AS order_id,
       {_cents('amount', 100, 900)} AS amount,
       CASE WHEN {_u('payment_method')} <= 1073741824 THEN 'credit_card' ELSE 'paypal' END AS payment_method,
       CASE WHEN {_u('status')} <= 1073741824 THEN 'completed' ELSE 'pending' END AS status,
       {_AS_OF} AS transaction_date
FROM (SELECT o_orderkey + 1 AS n FROM orders)"""
    q["seed_inventory_logs"] = f"""
SELECT CAST(n AS INTEGER) AS log_id, CAST({_below('product_id', 1000)} + 1 AS INTEGER) AS product_id,
       CAST({_below('change_quantity', 21)} - 10 AS INTEGER) AS change_quantity,
       CASE WHEN {_below('reason', 2)} = 0 THEN 'order_fulfillment' ELSE 'restock' END AS reason,
       {_AS_OF} AS created_at
FROM (SELECT event_id + 1 AS n FROM events)"""

    q["snapshot_events"] = W_V + "SELECT k, 'r' AS op, CAST(1 AS BIGINT) AS seq, status, total, order_date FROM v1"
    q["capture_diff"] = W_V + ("SELECT k, op, seq, before_status, after_status, before_total, after_total FROM ("
                               + _cap("v1", "v2", 1) + ")")
    q["snapshot_then_log"] = W_LOG + ("SELECT k, 'r' AS op, CAST(1 AS BIGINT) AS seq, status, total FROM v2 "
                                      "UNION ALL SELECT k, op, seq, after_status, after_total FROM log WHERE seq > 1")
    q["net_changes"] = W_NET + "SELECT k, op, seq, before_status, after_status FROM net"
    q["net_changes_events"] = """
WITH ev AS (SELECT user_id, event_id AS seq, event_type,
                   CASE WHEN event_type = 'signup' THEN 'c' WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op
            FROM events),
g AS (SELECT user_id, MIN(seq) AS mn, MAX(seq) AS mx FROM ev GROUP BY user_id),
n AS (SELECT g.user_id, g.mx AS seq, l.event_type AS l_type,
             CASE WHEN f.op = 'c' AND l.op <> 'd' THEN 'c' WHEN f.op <> 'c' AND l.op <> 'd' THEN 'u'
                  WHEN f.op <> 'c' AND l.op = 'd' THEN 'd' END AS op
      FROM g JOIN ev f ON f.user_id = g.user_id AND f.seq = g.mn
             JOIN ev l ON l.user_id = g.user_id AND l.seq = g.mx)
SELECT user_id, op, seq, CASE WHEN op <> 'd' THEN l_type END AS last_type FROM n WHERE op IS NOT NULL"""
    q["signal_snapshot"] = W_V + (
        "SELECT k, 'r' AS op, CAST(1 AS BIGINT) AS seq, CAST(floor(k / 1000) AS BIGINT) AS chunk, status FROM v1 "
        "WHERE NOT EXISTS (SELECT 1 FROM (" + _cap("v1", "v2", 2) + ") w WHERE w.k = v1.k)")
    q["route_mixed"] = W_LOG + "SELECT k, op, seq, before_status, after_status, before_total, after_total FROM log"
    q["unwrap_after"] = W_LOG + ("SELECT k, after_status AS status, after_total AS total, "
                                 "after_order_date AS order_date, op, seq FROM log WHERE op <> 'd'")
    q["tombstones_on"] = W_LOG + ("SELECT k, op, seq, FALSE AS is_tombstone, op = 'd' AS is_null_value FROM log "
                                  "UNION ALL SELECT k, op, seq, TRUE, TRUE FROM log WHERE op = 'd'")
    q["tombstones_off"] = W_LOG + "SELECT k, op, seq, FALSE AS is_tombstone, op = 'd' AS is_null_value FROM log"
    q["event_keys"] = W_LOG + "SELECT k, op, seq, '{\"k\":' || CAST(k AS VARCHAR) || '}' AS key_json FROM log"
    q["kafka_records"] = W_LOG + (
        "SELECT 'ecomm-postgres.public.orders' AS topic, '{\"k\":' || CAST(k AS VARCHAR) || '}' AS key, "
        + _VALUE_LOG + " AS value FROM log")
    q["kafka_tombstones"] = q["kafka_records"] + "\nUNION ALL SELECT 'ecomm-postgres.public.orders' AS topic, '{\"k\":' || k || '}' AS key, NULL AS value FROM log WHERE op = 'd'"
    q["json_schema_typed"] = f"""
WITH h0 AS (SELECT o_orderkey AS k, epoch_ms(o_orderdate) AS ms, to_hex(CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT)) AS h FROM orders),
h1 AS (SELECT k, ms, CASE WHEN length(h) % 2 = 1 THEN '0' || h ELSE h END AS h FROM h0),
h2 AS (SELECT k, ms, CASE WHEN substr(h, 1, 1) >= '8' THEN '00' || h ELSE h END AS h FROM h1)
SELECT k, '{{"schema":{_TYPED_SCHEMA},"payload":{{"k":' || k || ',"total":"' || to_base64(from_hex(h)) || '","at":' || ms || '}}}}' AS value FROM h2"""
    q["avro_names"] = 'SELECT o_orderkey AS order_key, o_custkey AS "_2nd_key" FROM orders'
    q["unwrap_rewrite"] = W_LOG + (
        "SELECT k, CASE WHEN op = 'd' THEN before_status ELSE after_status END AS status, CASE WHEN op = 'd' THEN before_total ELSE after_total END AS total, "
        "CASE WHEN op = 'd' THEN before_order_date ELSE after_order_date END AS order_date, CASE WHEN op = 'd' THEN 'true' ELSE 'false' END AS is_deleted, op, seq FROM log")
    q["unwrap_null"] = W_LOG + "SELECT k, after_status AS status, after_total AS total, after_order_date AS order_date, op, seq FROM log"
    q["replay_snapshot_log"] = W_V + "SELECT k, status, total, order_date FROM v3"
    q["chained_flow"] = W_LOG + "SELECT 'ecomm-postgres.public.orders' AS topic, '{\"k\":' || k || '}' AS key_json, op, seq FROM log"
    q["stream_feed"] = q["kafka_records"]
    q["json_schema_payload"] = W_V + (
        "SELECT CAST(k AS VARCHAR) AS k, '{\"schema\":" + _PAYLOAD_SCHEMA.replace("'", "''") + ",\"payload\":' || "
        "CAST(json_object('k', CAST(k AS VARCHAR), 'status', status, 'total', CAST(total AS VARCHAR), "
        "'order_date', CAST(order_date AS VARCHAR)) AS VARCHAR) || '}' AS value FROM v1")
    q["apply_changes"] = W_V + "SELECT k, status, total, order_date FROM v3"
    q["change_feed"] = W_NET + (
        "SELECT 'ecomm-postgres.public.orders' AS topic, '{\"k\":' || CAST(k AS VARCHAR) || '}' AS key, "
        "CAST(json_object('op', 'r', 'seq', '0', 'status', status, 'total', CAST(total AS VARCHAR), "
        "'order_date', CAST(order_date AS VARCHAR)) AS VARCHAR) AS value FROM v1 "
        "UNION ALL SELECT 'ecomm-postgres.public.orders', '{\"k\":' || CAST(k AS VARCHAR) || '}', "
        + _VALUE_LOG + " FROM net")

    q["nest_items"] = ("SELECT l_orderkey, CAST(COUNT(*) AS BIGINT) AS n_items, "
                       "CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS items_total "
                       "FROM lineitem GROUP BY l_orderkey")
    q["unnest_items"] = ("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DECIMAL(12,2)) AS quantity, "
                         "CAST(l_extendedprice AS DECIMAL(12,2)) AS price FROM lineitem")
    q["reconcile_totals"] = """
SELECT o.o_orderkey,
       CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) AS DECIMAL(18,2)) AS order_total,
       CAST(COALESCE(s.t, 0) AS DECIMAL(18,2)) AS items_total,
       CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) - COALESCE(s.t, 0) AS DECIMAL(18,2)) AS difference
FROM orders o LEFT JOIN
     (SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS t FROM lineitem GROUP BY l_orderkey) s
  ON o.o_orderkey = s.l_orderkey"""
    q["parse_props"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"
    q["stream_changes"] = (
        "SELECT 'public.inventory_logs' AS \"table\", CASE WHEN event_type = 'signup' THEN 'c' "
        "WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op, event_id AS seq, user_id, event_type FROM events")
    q["stream_dedup"] = "SELECT DISTINCT event_id, user_id, event_type FROM events"
    q["include_databases"] = "WITH " + _MIXED_SQLSERVER + "SELECT * FROM mixed WHERE split_part(\"table\", '.', 1) = 'ecommerce'"
    q["parse_tags"] = ("SELECT p_partkey, CAST(i AS INTEGER) AS place, [p_brand, p_type, p_name][i + 1] AS tag FROM part, range(3) r(i) WHERE p_partkey % 10 > 2")
    q["nested_arrays"] = """
WITH placed AS (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
                       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS n FROM lineitem)
SELECT l_orderkey, CAST(n // 4 AS INTEGER) AS chunk, CAST(n % 4 AS INTEGER) AS place, l_linenumber AS line, l_partkey AS part, price FROM placed"""
    from changeflow.plans.incremental import ORACLE

    return q | ORACLE

"""Canonical schemas: relational shapes, the document shape and the change event."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L = T.StringType(), T.IntegerType(), T.LongType()
NTZ, TS, B = T.TimestampNTZType(), T.TimestampType(), T.BooleanType()
MONEY10 = T.DecimalType(10, 2)
MONEY12 = T.DecimalType(12, 2)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# The relational shape (PostgreSQL dialect): table -> schema, key columns.
RELATIONAL = {
    "categories": (_struct(("category_id", I, False), ("name", S, False), ("description", S, True)), ["category_id"]),
    "products": (
        _struct(("product_id", I, False), ("name", S, False), ("price", MONEY10, False),
                ("stock_quantity", I, False), ("category_id", I, False), ("updated_at", NTZ, True)),
        ["product_id"],
    ),
    "users": (
        _struct(("user_id", I, False), ("username", S, False), ("email", S, False),
                ("created_at", NTZ, True), ("last_login", NTZ, True)),
        ["user_id"],
    ),
    "orders": (
        _struct(("order_id", I, False), ("user_id", I, False), ("order_date", NTZ, True),
                ("status", S, False), ("total_amount", MONEY10, False)),
        ["order_id"],
    ),
    "order_items": (
        _struct(("order_item_id", I, False), ("order_id", I, False), ("product_id", I, False),
                ("quantity", I, False), ("unit_price", MONEY10, False)),
        ["order_item_id"],
    ),
    "payments": (
        _struct(("payment_id", I, False), ("order_id", I, False), ("amount", MONEY10, False),
                ("payment_method", S, False), ("status", S, False), ("transaction_date", NTZ, True)),
        ["payment_id"],
    ),
    "inventory_logs": (
        _struct(("log_id", I, False), ("product_id", I, False), ("change_quantity", I, False),
                ("reason", S, False), ("created_at", NTZ, True)),
        ["log_id"],
    ),
}

# The declared foreign keys of the relational shape (child, column, parent, column).
RELATIONAL_FKS = [
    ("products", "category_id", "categories", "category_id"),
    ("orders", "user_id", "users", "user_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("inventory_logs", "product_id", "products", "product_id"),
]

# The relational shape of the SQL Server dialect, string keys throughout.
SQLSERVER = {
    "categories": (_struct(("id", S, False), ("name", S, False), ("description", S, True), ("created_at", NTZ, False), ("updated_at", NTZ, False)), ["id"]),
    "products": (
        _struct(("id", S, False), ("name", S, False), ("category_id", S, True), ("price", MONEY12, False), ("stock_quantity", I, False),
                ("tags", S, True), ("created_at", NTZ, False), ("updated_at", NTZ, False)),
        ["id"],
    ),
    "users": (_struct(("id", S, False), ("username", S, False), ("email", S, False)), ["id"]),
    "orders": (
        _struct(("id", S, False), ("user_id", S, False), ("status", S, False), ("total_amount", MONEY12, False),
                ("created_at", NTZ, False), ("updated_at", NTZ, False)),
        ["id"],
    ),
    "order_items": (
        _struct(("order_id", S, False), ("product_id", S, False), ("name", S, False), ("quantity", I, False), ("unit_price", MONEY12, False)),
        ["order_id", "product_id"],
    ),
}
SQLSERVER_FKS = [
    ("products", "category_id", "categories", "id"),
    ("orders", "user_id", "users", "id"),
    ("order_items", "order_id", "orders", "id"),
]
# Unique columns besides the keys: (table, columns).
SQLSERVER_UNIQUE = [("users", ["username"]), ("users", ["email"])]

# Document shape: one order with its user embedded and its items as an array.
USER_DOC = _struct(("user_id", S, True), ("name", S, True), ("username", S, True), ("email", S, True))
ITEM_DOC = _struct(("product_id", S, True), ("name", S, True), ("quantity", I, True), ("unit_price", MONEY12, True))
ORDER_DOC = _struct(
    ("_id", S, False), ("status", S, True), ("user", USER_DOC, True),
    ("items", T.ArrayType(ITEM_DOC), True), ("total", MONEY12, True), ("total_amount", MONEY12, True),
    ("created_at", TS, True), ("updated_at", TS, True),
)
PRODUCT_DOC = _struct(
    ("_id", S, False), ("name", S, True), ("description", S, True), ("category_id", S, True),
    ("price", MONEY12, True), ("stock", I, True), ("stock_quantity", I, True),
    ("tags", T.ArrayType(S), True), ("discontinued", B, True), ("created_at", TS, True), ("updated_at", TS, True),
)
CATEGORY_DOC = _struct(("_id", S, False), ("name", S, True), ("description", S, True), ("created_at", TS, True))
SIGNAL_DOC = _struct(("id", S, False), ("type", S, True), ("data", S, True))

# Driver test tables (read with a declared schema: no inference on the scan).
TABLES = {
    "region": _struct(("r_regionkey", I, True), ("r_name", S, True)),
    "nation": _struct(("n_nationkey", I, True), ("n_name", S, True), ("n_regionkey", I, True)),
    "customer": _struct(("c_custkey", L, True), ("c_name", S, True), ("c_nationkey", I, True),
                        ("c_acctbal", T.DoubleType(), True), ("c_mktsegment", S, True)),
    "supplier": _struct(("s_suppkey", L, True), ("s_name", S, True), ("s_nationkey", I, True),
                        ("s_acctbal", T.DoubleType(), True)),
    "part": _struct(("p_partkey", L, True), ("p_name", S, True), ("p_brand", S, True), ("p_type", S, True),
                    ("p_size", I, True), ("p_retailprice", T.DoubleType(), True)),
    "orders": _struct(("o_orderkey", L, True), ("o_custkey", L, True), ("o_orderstatus", S, True),
                      ("o_totalprice", T.DoubleType(), True), ("o_orderdate", NTZ, True),
                      ("o_orderpriority", S, True)),
    "lineitem": _struct(("l_orderkey", L, True), ("l_partkey", L, True), ("l_suppkey", L, True),
                        ("l_linenumber", I, True), ("l_quantity", T.DoubleType(), True),
                        ("l_extendedprice", T.DoubleType(), True), ("l_discount", T.DoubleType(), True),
                        ("l_tax", T.DoubleType(), True), ("l_returnflag", S, True), ("l_linestatus", S, True),
                        ("l_shipdate", NTZ, True)),
    "events": _struct(("event_id", L, True), ("ts", NTZ, True), ("user_id", L, True), ("event_type", S, True),
                      ("value", T.DoubleType(), True), ("props", S, True)),
}

# Declared candidate keys of the driver tables (used by catalog and uniqueness checks).
TABLE_KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}

ALL_TABLES = list(TABLE_KEYS)

# Change event envelope. key / before / after take the captured table's types.
OPS = ("r", "c", "u", "d")


def event_schema(key: T.StructType, row: T.StructType) -> T.StructType:
    return _struct(
        ("table", S, False), ("op", S, False), ("key", key, False),
        ("before", row, True), ("after", row, True), ("commit_ts", TS, True), ("seq", L, False),
    )


# Mixed-table stream: before/after travel as JSON text until routed to a typed table.
MIXED_EVENT = _struct(
    ("table", S, False), ("op", S, False), ("key", S, False),
    ("before", S, True), ("after", S, True), ("commit_ts", TS, True), ("seq", L, False),
)


class SchemaChangeError(ValueError):
    """An incoming batch changes the type of an existing field."""


def evolve(current: T.StructType, incoming: T.StructType) -> T.StructType:
    """Schema after a batch: new fields are appended as nullable, nested structs
    evolve field by field, and a changed type is an error (the batch fails)."""
    fields = {f.name: f for f in current.fields}
    out = list(current.fields)
    for f in incoming.fields:
        if f.name not in fields:
            out.append(T.StructField(f.name, f.dataType, True))
            continue
        have = fields[f.name]
        if isinstance(have.dataType, T.StructType) and isinstance(f.dataType, T.StructType):
            merged = evolve(have.dataType, f.dataType)
            out[out.index(have)] = T.StructField(have.name, merged, have.nullable)
        elif have.dataType != f.dataType:
            raise SchemaChangeError(f"field {f.name!r}: {have.dataType.simpleString()} -> "
                                    f"{f.dataType.simpleString()}")
    return T.StructType(out)


def _conform_col(col, have: T.DataType, want: T.DataType):
    from pyspark.sql import functions as F

    if isinstance(have, T.StructType) and isinstance(want, T.StructType) and have != want:
        names = {f.name: f.dataType for f in have.fields}
        parts = [(_conform_col(col[f.name], names[f.name], f.dataType) if f.name in names
                  else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(col.isNull(), F.lit(None).cast(want)).otherwise(F.struct(*parts))
    return col.cast(want)


def conform(df, schema: T.StructType):
    """Project ``df`` onto ``schema``: missing fields (top level or nested) become typed NULLs."""
    from pyspark.sql import functions as F

    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[(_conform_col(F.col(f.name), have[f.name], f.dataType) if f.name in have
                        else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])

"""Seed generators for the e-commerce model (GEN-1..8).

GEN-1..7 take a row source ``ids`` with a column ``n`` (the rows of
``generate_series``) and derive every value from ``n`` through the hash draws
in ``functions.draws``, so results repeat exactly and do not depend on how rows
fall into partitions. Timestamps that are ``NOW()`` in a database are an
explicit ``as_of`` argument.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions.draws import draw_below, draw_round_cents, rint_flag
from changeflow.functions.expressions import ts_ntz
from changeflow.schemas import CATEGORY_DOC, ORDER_DOC, PRODUCT_DOC

DEFAULT_AS_OF = "2026-01-01 00:00:00"

# Fixed values of the relational seed: foreign-key ranges and label sets.
N_CATEGORIES = 10
N_USERS = 1000
N_ORDERS = 1000
N_PRODUCTS = 1000
ORDER_STATUSES = ("pending", "shipped", "cancelled")
PAYMENT_METHODS = ("credit_card", "paypal")
PAYMENT_STATUSES = ("completed", "pending")
INVENTORY_REASONS = ("order_fulfillment", "restock")


def _n() -> Column:
    return F.col("n")


def _id() -> Column:
    return _n().cast("int")


def seed_categories(ids: DataFrame) -> DataFrame:
    """GEN-1: ``'Category ' || n`` and its description."""
    return ids.select(
        _id().alias("category_id"),
        F.concat(F.lit("Category "), _n().cast("string")).alias("name"),
        F.concat(F.lit("Description for Category "), _n().cast("string")).alias("description"),
    )


def seed_products(ids: DataFrame, as_of: str = DEFAULT_AS_OF, n_categories: int = N_CATEGORIES) -> DataFrame:
    """GEN-2: price 10.00-100.00, stock 0-100, category 1..n_categories."""
    return ids.select(
        _id().alias("product_id"),
        F.concat(F.lit("Product "), _n().cast("string")).alias("name"),
        draw_round_cents(_n(), "price", 10, 90).alias("price"),
        draw_below(_n(), "stock_quantity", 101).cast("int").alias("stock_quantity"),
        (draw_below(_n(), "category_id", n_categories) + 1).cast("int").alias("category_id"),
        ts_ntz(as_of).alias("updated_at"),
    )


def seed_users(ids: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """GEN-3: ``user_n``, ``user_n@example.com``, both times ``as_of - n minutes``."""
    at = F.timestamp_add("MINUTE", -_n(), ts_ntz(as_of))
    return ids.select(
        _id().alias("user_id"),
        F.concat(F.lit("user_"), _n().cast("string")).alias("username"),
        F.concat(F.lit("user_"), _n().cast("string"), F.lit("@example.com")).alias("email"),
        at.alias("created_at"),
        at.alias("last_login"),
    )


def seed_orders(ids: DataFrame, as_of: str = DEFAULT_AS_OF, n_users: int = N_USERS) -> DataFrame:
    """GEN-4: user 1..n_users, status one third each, total 100.00-1000.00.

    The CASE operand is drawn once into a column before the CASE: an inline
    random operand would be re-drawn for every WHEN branch.
    """
    pick = draw_below(_n(), "status", 3)
    status = (
        F.when(pick == 0, F.lit(ORDER_STATUSES[0]))
        .when(pick == 1, F.lit(ORDER_STATUSES[1]))
        .otherwise(F.lit(ORDER_STATUSES[2]))
    )
    return ids.select(
        _id().alias("order_id"),
        (draw_below(_n(), "user_id", n_users) + 1).cast("int").alias("user_id"),
        ts_ntz(as_of).alias("order_date"),
        status.alias("status"),
        draw_round_cents(_n(), "total_amount", 100, 900).alias("total_amount"),
    )


def seed_order_items(ids: DataFrame, n_orders: int = N_ORDERS, n_products: int = N_PRODUCTS) -> DataFrame:
    """GEN-5: order and product references, quantity 1-5, unit price 10.00-100.00."""
    return ids.select(
        _id().alias("order_item_id"),
        (draw_below(_n(), "order_id", n_orders) + 1).cast("int").alias("order_id"),
        (draw_below(_n(), "product_id", n_products) + 1).cast("int").alias("product_id"),
        (draw_below(_n(), "quantity", 5) + 1).cast("int").alias("quantity"),
        draw_round_cents(_n(), "unit_price", 10, 90).alias("unit_price"),
    )


def seed_payments(ids: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """GEN-6: one payment per order (order = n).

    ``(random() * 2)::INT`` rounds to nearest (half to even), so the first label
    is chosen when U <= 1/4: 25 % credit_card / completed, 75 % the other.
    """
    return ids.select(
        _id().alias("payment_id"),
        _id().alias("order_id"),
        draw_round_cents(_n(), "amount", 100, 900).alias("amount"),
        F.when(rint_flag(_n(), "payment_method"), F.lit(PAYMENT_METHODS[0]))
        .otherwise(F.lit(PAYMENT_METHODS[1])).alias("payment_method"),
        F.when(rint_flag(_n(), "status"), F.lit(PAYMENT_STATUSES[0]))
        .otherwise(F.lit(PAYMENT_STATUSES[1])).alias("status"),
        ts_ntz(as_of).alias("transaction_date"),
    )


def seed_inventory_logs(ids: DataFrame, as_of: str = DEFAULT_AS_OF, n_products: int = N_PRODUCTS) -> DataFrame:
    """GEN-7: product 1..n_products, change -10..10, reason half each."""
    return ids.select(
        _id().alias("log_id"),
        (draw_below(_n(), "product_id", n_products) + 1).cast("int").alias("product_id"),
        (draw_below(_n(), "change_quantity", 21) - 10).cast("int").alias("change_quantity"),
        F.when(draw_below(_n(), "reason", 2) == 0, F.lit(INVENTORY_REASONS[0]))
        .otherwise(F.lit(INVENTORY_REASONS[1])).alias("reason"),
        ts_ntz(as_of).alias("created_at"),
    )


# ---------------------------------------------------------------------------
# GEN-8: document fixtures. The literal documents of the two
# document seeds, "A" (every field set) and "B" ($set plus $setOnInsert).
# ---------------------------------------------------------------------------

_T0 = datetime(2026, 1, 1, 0, 0, 0)

CATEGORY_ROWS = [
    ("cat-electronics", "Electronics", "Devices, gadgets, and accessories"),
    ("cat-books", "Books", "Printed and digital books"),
    ("cat-home", "Home", "Home and kitchen products"),
]

# A: _id, name, description, category_id, price, stock, discontinued
PRODUCTS_A = [
    ("prod-laptop-1", "Developer Laptop", "High-performance laptop for development workloads",
     "cat-electronics", "1999.99", 15, False),
    ("prod-keyboard-1", "Mechanical Keyboard", "Compact mechanical keyboard", "cat-electronics", "129.99", 40, False),
    ("prod-book-1", "Change Data Capture Handbook", "Practical guide to CDC patterns", "cat-books", "49.99", 100, False),
]
# B: _id, name, category_id, price, stock_quantity, tags
PRODUCTS_B = [
    ("prod-laptop-1", "Developer Laptop", "cat-electronics", "1299.99", 25, ["computer", "developer", "portable"]),
    ("prod-keyboard-1", "Mechanical Keyboard", "cat-electronics", "149.99", 100, ["keyboard", "accessory"]),
    ("prod-book-1", "Change Data Capture Handbook", "cat-books", "39.99", 50, ["book", "data", "cdc"]),
]
# A: _id, status, (user_id, name, email), [(product_id, name, quantity, unit_price)], total
ORDERS_A = [
    ("order-1001", "PLACED", ("user-1", "Alice Example", "alice@example.com"),
     [("prod-laptop-1", "Developer Laptop", 1, "1999.99"), ("prod-keyboard-1", "Mechanical Keyboard", 1, "129.99")],
     "2129.98"),
    ("order-1002", "SHIPPED", ("user-2", "Bob Example", "bob@example.com"),
     [("prod-book-1", "Change Data Capture Handbook", 2, "49.99")], "99.98"),
]
# B: _id, status, (user_id, username, email), items, total_amount, created_at on insert
ORDERS_B = [
    ("order-1001", "pending", ("user-1", "alice", "alice@example.com"),
     [("prod-laptop-1", "Developer Laptop", 1, "1299.99"), ("prod-keyboard-1", "Mechanical Keyboard", 1, "149.99")],
     "1449.98", datetime(2026, 1, 1, 10, 0, 0)),
    ("order-1002", "paid", ("user-2", "bob", "bob@example.com"),
     [("prod-book-1", "Change Data Capture Handbook", 1, "39.99")], "39.99", datetime(2026, 1, 2, 11, 0, 0)),
]


def _dec(x: str):
    from decimal import Decimal

    return Decimal(x)


def seed_documents(spark: SparkSession, variant: str) -> dict[str, DataFrame]:
    """GEN-8: the three collections of one document seed as nested DataFrames.

    Returns {"categories", "products", "orders"}; each has the full canonical
    document schema, with NULL for fields the variant does not write.
    ``fields`` lists, per collection, the fields the variant ``$set``s, which
    is what ``doc_upsert`` needs (absent and NULL are not told apart by a row).
    """
    if variant not in ("A", "B"):
        raise ValueError("variant is 'A' or 'B'")
    cats = spark.createDataFrame([(i, n, d, _T0) for i, n, d in CATEGORY_ROWS], CATEGORY_DOC)
    if variant == "A":
        prods = [
            (i, n, d, c, _dec(p), s, None, None, disc, _T0, _T0) for i, n, d, c, p, s, disc in PRODUCTS_A
        ]
        orders = [
            (i, st, (u[0], u[1], None, u[2]), [(a, b, q, _dec(up)) for a, b, q, up in items], _dec(tot), None,
             _T0, _T0)
            for i, st, u, items, tot in ORDERS_A
        ]
    else:
        prods = [(i, n, None, c, _dec(p), None, s, tags, None, _T0, _T0) for i, n, c, p, s, tags in PRODUCTS_B]
        orders = [
            (i, st, (u[0], None, u[1], u[2]), [(a, b, q, _dec(up)) for a, b, q, up in items], None, _dec(tot),
             created, _T0)
            for i, st, u, items, tot, created in ORDERS_B
        ]
    return {
        "categories": cats,
        "products": spark.createDataFrame(prods, PRODUCT_DOC),
        "orders": spark.createDataFrame(orders, ORDER_DOC),
    }


# Fields each variant writes with $set (A writes everything it has, created_at included).
SET_FIELDS = {
    "A": {
        "categories": ["name", "description"],
        "products": ["name", "description", "category_id", "price", "stock", "created_at", "updated_at",
                     "discontinued"],
        "orders": ["status", "user", "items", "total", "created_at", "updated_at"],
    },
    "B": {
        "categories": ["name", "description"],
        "products": ["name", "category_id", "price", "stock_quantity", "tags", "updated_at"],
        "orders": ["user", "status", "total_amount", "items", "updated_at"],
    },
}
# Fields each variant writes only on insert ($setOnInsert).
SET_ON_INSERT = {
    "A": {"categories": ["created_at"], "products": [], "orders": []},
    "B": {"categories": ["created_at"], "products": ["created_at"], "orders": ["created_at"]},
}


def doc_types() -> dict[str, T.StructType]:
    return {"categories": CATEGORY_DOC, "products": PRODUCT_DOC, "orders": ORDER_DOC}

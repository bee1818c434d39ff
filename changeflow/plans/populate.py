"""Populate the relational e-commerce model: seven keyed upserts published together.

Each table's seed rows (GEN-1..7) are upserted into the current version of the
table with that table's conflict column list (MUT-1/MUT-2), and all seven
results are published as one new version (MUT-7): readers see every table of
the previous load or every table of this one. Re-running with the same seeds
leaves every table's content unchanged except the touched ``updated_at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changeflow.functions.expressions import ts_ntz
from changeflow.operators import seed
from changeflow.operators.mutate import upsert
from changeflow.schemas import RELATIONAL
from changeflow.sinks.tables import current_version, load_all, read_current
from changeflow.sources.tables import series

# Columns updated on conflict, per table (others keep the stored value).
CONFLICT_SET = {
    "categories": ["name", "description"],
    "products": ["name", "price", "stock_quantity", "category_id"],
    "users": ["username", "email", "created_at", "last_login"],
    "orders": ["user_id", "status", "total_amount"],
    "order_items": ["order_id", "product_id", "quantity", "unit_price"],
    "payments": ["order_id", "amount", "payment_method", "status"],
    "inventory_logs": ["product_id", "change_quantity", "reason"],
}
# Columns set to the load time on conflict.
CONFLICT_TOUCH = {"products": ["updated_at"]}


def seed_frames(spark: SparkSession, n: int = 1000, n_categories: int = seed.N_CATEGORIES,
                as_of: str = seed.DEFAULT_AS_OF) -> dict[str, DataFrame]:
    """The seven seed tables with ``n`` rows each (``n_categories`` categories)."""
    ids = series(spark, 1, n)
    return {
        "categories": seed.seed_categories(series(spark, 1, n_categories)),
        "products": seed.seed_products(ids, as_of, n_categories),
        "users": seed.seed_users(ids, as_of),
        "orders": seed.seed_orders(ids, as_of, n_users=n),
        "order_items": seed.seed_order_items(ids, n_orders=n, n_products=n),
        "payments": seed.seed_payments(ids, as_of),
        "inventory_logs": seed.seed_inventory_logs(ids, as_of, n_products=n),
    }


def populate(spark: SparkSession, root: str, frames: dict[str, DataFrame], as_of: str = seed.DEFAULT_AS_OF,
             version: int | None = None) -> int:
    """Upsert every frame into its current table and publish all of them at once."""
    have = current_version(spark, root)
    out = {}
    for name, src in frames.items():
        schema, key = RELATIONAL[name]
        if have is None:
            target = spark.createDataFrame([], schema)
        else:
            target = read_current(spark, root, name, schema)
        touch = {c: ts_ntz(as_of) for c in CONFLICT_TOUCH.get(name, [])}
        out[name] = upsert(target, src, key, CONFLICT_SET[name], touch=touch)
    return load_all(spark, root, out, version=version)

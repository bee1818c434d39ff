"""A mixed-table change stream derived from three driver tables.

Rows of ``orders``, ``customer`` and ``part`` become (table, key) records
named as a relational source would name them. Include lists, routing and
capture lists run over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.sources.tables import scan_table

# The table names of the three sources each naming scheme uses.
PG_NAMES = {"orders": "public.orders", "customer": "public.users", "part": "public.products"}
SQLSERVER_NAMES = {"orders": "ecommerce.data.orders", "customer": "public.users", "part": "ecommerce.data.products"}
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey"}

# Capture lists: the scenario's two tables and the connector's seven.
SCENARIO_TABLES = ["public.users", "public.orders"]
CONNECTOR_TABLES = [
    "public.categories", "public.products", "public.users", "public.orders",
    "public.order_items", "public.payments", "public.inventory_logs",
]
TOPIC_PREFIX = "ecomm-postgres"


def mixed_keys(spark: SparkSession, sf_dir: str, names: dict[str, str] = PG_NAMES) -> DataFrame:
    parts = [
        scan_table(spark, sf_dir, t).select(F.lit(names[t]).alias("table"), F.col(KEYS[t]).alias("key"))
        for t in ("orders", "customer", "part")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

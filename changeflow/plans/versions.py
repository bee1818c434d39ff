"""Versions of the orders table and the change log between them.

The capture queries need a table that changes. Three versions are derived
from the driver's ``orders`` table by fixed key rules, over every row:

* V1: orders as stored, row = (k, status, total DECIMAL(12,2), order_date);
* V2: keys = 0 mod 10 deleted, status 'X' for keys = 1, 2 mod 10, and a copy
  of each key = 3 mod 10 inserted under the negated key (stored keys are positive);
* V3 (from V1): keys = 5 mod 10 deleted, status 'Y' for keys = 1 mod 10, and
  the negated key with status 'Z' for keys = 3 mod 20.

LOG = capture(V1, V2) at seq 1 followed by capture(V2, V3) at seq 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators.capture import capture
from changeflow.sources.tables import scan_table

TABLE = "public.orders"
KEY = ["k"]
TS_1 = "2026-01-01 00:00:00"
TS_2 = "2026-01-02 00:00:00"


def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scan_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
        F.col("o_orderdate").alias("order_date"),
    )


def v2_from(base: DataFrame) -> DataFrame:
    m = F.col("k") % 10
    kept = base.filter(m != 0).withColumn(
        "status", F.when(m.isin(1, 2), F.lit("X")).otherwise(F.col("status"))
    )
    added = base.filter(m == 3).withColumn("k", -F.col("k"))
    return kept.unionByName(added)


def v3_from(base: DataFrame) -> DataFrame:
    m = F.col("k") % 10
    kept = base.filter(m != 5).withColumn("status", F.when(m == 1, F.lit("Y")).otherwise(F.col("status")))
    added = base.filter(F.col("k") % 20 == 3).select(
        (-F.col("k")).alias("k"), F.lit("Z").alias("status"), "total", "order_date"
    )
    return kept.unionByName(added)


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = v1(spark, sf_dir)
    return base, v2_from(base), v3_from(base)


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = versions(spark, sf_dir)
    return capture(a, b, TABLE, KEY, 1, TS_1).unionByName(capture(b, c, TABLE, KEY, 2, TS_2))


def flat_event(events: DataFrame) -> DataFrame:
    """Events as flat columns (k, op, seq, before_*, after_*) for checking."""
    return events.select(
        F.col("key.k").alias("k"),
        "op",
        "seq",
        F.col("before.status").alias("before_status"),
        F.col("after.status").alias("after_status"),
        F.col("before.total").alias("before_total"),
        F.col("after.total").alias("after_total"),
    )

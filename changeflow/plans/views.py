"""SQL access: the tables and the registered queries as temporary views.

After ``register_views(spark, dir)`` a user can write, for example,
``spark.sql("SELECT op, count(*) FROM net_changes GROUP BY op")``. Views are
plans; building a few of them runs one small bounded job (the next id, a
capture list's names, a hot-key count), the rest runs when a query over the
view does. Queries that write as they are built (streams, the bucket layout)
are left out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from changeflow.plans.registry import QUERIES
from changeflow.schemas import ALL_TABLES
from changeflow.sources.tables import scan_table

EAGER = {"stream_changes", "stream_dedup", "stream_feed", "bucketed_upsert"}


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    """Register every table and every lazy registered query; returns the view names."""
    names = []
    for t in ALL_TABLES:
        scan_table(spark, sf_dir, t).createOrReplaceTempView(prefix + t)
        names.append(prefix + t)
    for q, fn in QUERIES.items():
        if q in EAGER or q in ALL_TABLES:
            continue
        fn(spark, sf_dir).createOrReplaceTempView(prefix + q)
        names.append(prefix + q)
    return names

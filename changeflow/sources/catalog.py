"""SRC-7: catalog frames (tables, schemas, primary-key indexes) built from the data.

The relational sources answer ``sys.tables`` / ``sys.schemas`` / ``sys.indexes``
from their own metadata. Here the same three frames are derived from the
captured tables themselves: every table contributes its row count, and a
declared key counts as a primary key only when the data proves it unique and
non-null. The catalog therefore reads every table and grows with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.schemas import ALL_TABLES, TABLE_KEYS
from changeflow.sources.tables import scan_table

# Fixed catalog configuration (names as the driver's tables carry them).
DATA_SCHEMA_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
SCHEMAS = ((1, "data"), (2, "other"))
TRACKED_TABLES = ("customer", "orders")


def untracked_in_schema(schema_name: str) -> list[str]:
    """Names that can still become capture candidates (only they need the key proof)."""
    sid = dict((n, i) for i, n in SCHEMAS)[schema_name]
    return [t for t in ALL_TABLES
            if (1 if t in DATA_SCHEMA_TABLES else 2) == sid and t not in TRACKED_TABLES]


def schemas_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCHEMAS), "schema_id int, schema_name string")


def _object_id(name: str) -> int:
    return ALL_TABLES.index(name) + 1


def tables_frame(
    spark: SparkSession,
    sf_dir: str,
    tables: list[str] | None = None,
    tracked: tuple[str, ...] = TRACKED_TABLES,
) -> DataFrame:
    """``sys.tables``: object_id, table_name, schema_id, is_tracked_by_cdc, row_count."""
    parts = []
    for name in tables or ALL_TABLES:
        df = scan_table(spark, sf_dir, name).select(F.lit(1).alias("_one"))
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(_object_id(name)).alias("object_id"),
                F.lit(name).alias("table_name"),
                F.lit(1 if name in DATA_SCHEMA_TABLES else 2).alias("schema_id"),
                F.lit(name in tracked).alias("is_tracked_by_cdc"),
                F.col("row_count"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def indexes_frame(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> DataFrame:
    """``sys.indexes``: one row per declared key with ``is_primary_key`` proven by the data.

    ``count(distinct key) = count(*)`` is a two-phase aggregate: partial counts
    per task, one shuffle of the distinct keys, no group collected anywhere.
    Rows with a NULL key part are not counted by ``count(distinct)``, so they
    also disqualify the key.
    """
    parts = []
    for name in tables or ALL_TABLES:
        keys = TABLE_KEYS[name]
        df = scan_table(spark, sf_dir, name).select(*keys)
        parts.append(
            df.agg(
                (F.count_distinct(*[F.col(k) for k in keys]) == F.count(F.lit(1))).alias("is_primary_key")
            ).select(
                F.lit(_object_id(name)).alias("object_id"),
                F.lit(",".join(keys)).alias("key_columns"),
                F.col("is_primary_key"),
            )
        )
    return reduce(DataFrame.unionByName, parts)

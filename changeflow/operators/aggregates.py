"""Scalar aggregates, counters, existence flags, first-by-name and set deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def max_or_one(df: DataFrame, col: str, alias: str = "max_or_one", where: Column | None = None) -> Column:
    """AG-1: ``COALESCE(MAX(col), 1)`` as an aggregate expression (optionally filtered)."""
    value = F.col(col) if where is None else F.when(where, F.col(col))
    return F.coalesce(F.max(value), F.lit(1).cast(df.schema[col].dataType)).alias(alias)


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """AG-2: one report row per table: (table_name, row_count).

    Each count is a scan with an empty projection (Parquet answers it from
    footers) and the union keeps one row per table.
    """
    parts = [
        df.select(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("table_name"), "row_count")
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def counters(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """AG-3: conditional counters in one pass (``count_if`` per condition)."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])


def exists_flags(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """JN-4: one row of booleans, ``EXISTS (SELECT 1 ... WHERE predicate)`` each.

    Every probe is ``filter -> limit 1``: each task stops reading at its first
    match (the filter also reaches the Parquet scan), and at most one row per
    probe survives before the final count.
    """
    probes = [df.filter(p).select(F.lit(name).alias("_probe")).limit(1) for name, p in predicates.items()]
    hits = reduce(DataFrame.unionByName, probes)
    return hits.agg(*[(F.count_if(F.col("_probe") == F.lit(name)) > 0).alias(name) for name in predicates])


def first_by(df: DataFrame, predicate: Column, order_by: list[str]) -> DataFrame:
    """LIM-1: first row matching ``predicate`` in ``order_by`` order.

    ``orderBy(...).limit(1)`` plans as TakeOrderedAndProject: a per-task top-1
    and one merge, never a full sort.
    """
    return df.filter(predicate).orderBy(*order_by).limit(1)


def set_delta(old: DataFrame, new: DataFrame, col: str) -> DataFrame:
    """SET-1: replacing one set of names with another: rows (col, change) where
    change is ``added`` or ``removed``.

    Both sides are reduced to distinct values (partial aggregation), then met
    in one null-safe full outer join. (An anti join would be pushed by the
    optimizer into unions of literal-named branches, where it loses its equi
    key and turns into a nested-loop join.)
    """
    o = old.select(F.col(col).alias("_v")).distinct().withColumn("_o", F.lit(True)).alias("o")
    n = new.select(F.col(col).alias("_v")).distinct().withColumn("_n", F.lit(True)).alias("n")
    j = o.join(n, F.col("o._v").eqNullSafe(F.col("n._v")), "full_outer")
    change = F.when(F.col("o._o").isNull(), F.lit("added")).when(F.col("n._n").isNull(), F.lit("removed"))
    return j.select(F.coalesce(F.col("n._v"), F.col("o._v")).alias(col), change.alias("change")) \
        .filter(F.col("change").isNotNull())

"""Places of rows in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.llm.common import save
from changeflow.session import broadcast_if_bounded


def ranked(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``pos``, each row's place (from 0) within its ``group`` in ``order``, and ``n``, the group's rows.

    Rows are range-partitioned by (group, order), sorted and written with their
    partition and place in it; the places at which a group starts in each
    partition, one row a group and partition, turn these into places in the
    group. So a group that holds a third of all rows is spread like any other.
    Nulls of ``group`` are a group of their own.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    spread = save(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)
    spread = spread.withColumn("part", F.shiftright("at", 33))
    spans = spread.groupBy(F.col(group).alias("g"), F.col("part").alias("p")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy("g")
    before = F.sum("rows").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("g", "p", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(own).alias("n"))
    side = broadcast_if_bounded(save(spans, f"{name}-spans"))
    out = spread.join(side, (spread["part"] == side["p"]) & spread[group].eqNullSafe(side["g"]))
    return out.select(*[spread[c] for c in df.columns], (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")

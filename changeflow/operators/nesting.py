"""Table <-> document shape of orders, and order-total reconciliation.

DER-2 ``nest`` turns order lines into per-order ``items`` arrays, ``unnest``
turns them back into rows. DER-3 reconciles an order's stored total with the
sum of its lines, in decimal arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cents(amount: Column) -> Column:
    """A 2-decimal amount as exact integer cents (a long)."""
    return (amount * F.lit(100)).cast("bigint")


def _from_cents(cents: Column, precision: int) -> Column:
    """Integer cents back to DECIMAL(precision, 2), exactly."""
    return (cents.cast(f"decimal({precision},0)") / F.lit(100)).cast(f"decimal({precision},2)")


def nest(df: DataFrame, key: list[str], item_cols: list[str], items: str = "items",
         max_items: int | None = None) -> DataFrame:
    """DER-2: one document per key holding its items as a sorted array.

    By default a key is one document whatever its size (``chunk`` 0), as the
    documents of the collection are. A caller whose keys can outgrow one
    document sets ``max_items``: every key's sorted items are then cut into
    documents of at most that many, numbered by ``chunk``, equal items included.
    One pass and one shuffle by key either way.
    """
    item = F.struct(*[F.col(c) for c in item_cols])
    if max_items is None:
        docs = df.select(*key, item.alias("_item")).groupBy(*key).agg(F.sort_array(F.collect_list("_item")).alias(items))
        return docs.select(*key, F.lit(0).alias("chunk"), items)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_item")) - 1
    cut = df.select(*key, item.alias("_item")).withColumn("chunk", F.floor(place / max_items).cast("int"))
    return cut.groupBy(*key, "chunk").agg(F.sort_array(F.collect_list("_item")).alias(items))


def unnest(docs: DataFrame, key: list[str], items: str = "items") -> DataFrame:
    """DER-2: one row per array element, key columns repeated (a narrow explode)."""
    return docs.select(*key, F.explode(F.col(items)).alias("_item")).select(*key, "_item.*")


def doc_summary(docs: DataFrame, key: list[str], amount: str, items: str = "items",
                precision: int = 18) -> DataFrame:
    """Per-key item count and amount sum over (possibly chunked) documents.

    ``aggregate`` folds each bounded array in place; the outer sum combines the
    chunks of one key with partial aggregation.
    """
    # Sums run over exact integer cents in longs: a DECIMAL sum widens past 18
    # digits, where Spark's buffer becomes a BigDecimal and slows down sharply.
    folded = F.aggregate(F.col(items), F.lit(0).cast("bigint"), lambda acc, x: acc + _cents(x[amount]))
    return docs.groupBy(*key).agg(
        F.sum(F.size(F.col(items))).cast("bigint").alias("n_items"),
        _from_cents(F.sum(folded), precision).alias("items_total"),
    )


def reconcile_totals(orders: DataFrame, lines: DataFrame, order_key: str, line_key: str,
                     order_total: Column, line_amount: Column, precision: int = 18) -> DataFrame:
    """DER-3: stored order total against the sum of its lines, with the difference.

    The line sum is a partial aggregate (hot orders shrink before the
    shuffle); its output is already partitioned on the order key, so the join
    with the orders shuffles only the orders side. Orders without lines sum
    to zero.
    """
    dec = f"decimal({precision},2)"
    # Exact cents in a long, not a widened DECIMAL buffer (see ``doc_summary``).
    sums = lines.groupBy(F.col(line_key).alias("_lk")).agg(
        _from_cents(F.sum(_cents(line_amount)), precision).alias("items_total"))
    j = orders.join(sums, orders[order_key] == sums["_lk"], "left")
    total = order_total.cast(dec)
    items_total = F.coalesce(F.col("items_total"), F.lit(0).cast(dec))
    return j.select(
        F.col(order_key),
        total.alias("order_total"),
        items_total.alias("items_total"),
        (total - items_total).cast(dec).alias("difference"),
    )


def reconcile_documents(docs: DataFrame, key: str, total_field: str, items: str = "items",
                        precision: int = 18) -> DataFrame:
    """DER-3 on documents: ``total`` against the fold of quantity x unit_price."""
    dec = f"decimal({precision},2)"
    folded = F.aggregate(
        F.col(items), F.lit(0).cast(dec),
        lambda acc, x: (acc + x["quantity"] * x["unit_price"]).cast(dec),
    )
    return docs.select(
        F.col(key),
        F.col(total_field).cast(dec).alias("order_total"),
        folded.alias("items_total"),
        (F.col(total_field).cast(dec) - folded).cast(dec).alias("difference"),
    )

"""AG-2, AG-3, DER-3 maintained from changes: counters and totals folded without reading the table.

Every event takes its row before from its group and adds its row after to its
group: -1 and +1 in the counter, minus and plus the value in a total. Signed
amounts combine in any order, so tasks add them up before the exchange and a hot
group costs one row a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Amount = Callable[[Column], Column]


def aggregate_rows(df: DataFrame, by: list[str], sums: dict[str, Amount] | None = None) -> DataFrame:
    """(by..., n, sums...) of a table's rows: the stored aggregate that ``fold_changes`` maintains."""
    row = F.struct(*df.columns)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(amount(row)).alias(c) for c, amount in (sums or {}).items()])


def once_each(events: DataFrame) -> DataFrame:
    """(key, seq, before, after) of every event, once however often it was delivered; different events of a key at one ``seq`` fail the job."""
    content = F.struct("before", "after")
    h = F.xxhash64(F.to_json(content))
    one = events.groupBy("key", "seq").agg(F.first(content).alias("e"), F.min(h).alias("lo"), F.max(h).alias("hi"))
    fail = F.raise_error(F.lit("change log has different events with equal seq for one key")).cast("boolean")
    return one.filter(F.when(F.col("lo") == F.col("hi"), F.lit(True)).otherwise(fail)).select("key", "seq", "e.before", "e.after")


def deltas(events: DataFrame, by: list[str], sums: dict[str, Amount] | None = None) -> DataFrame:
    """(by..., n, sums...) of signed changes a group: rows after count once, rows before minus once."""
    sides = F.array(F.struct(F.col("before").alias("row"), F.lit(-1).alias("sign")), F.struct(F.col("after").alias("row"), F.lit(1).alias("sign")))
    signed = events.select(F.explode(F.filter(sides, lambda x: x["row"].isNotNull())).alias("x")).select("x.row", "x.sign")
    total = [F.sum(F.col("sign") * amount(F.col("row"))).alias(c) for c, amount in (sums or {}).items()]
    return signed.groupBy(*[F.col("row").getField(c).alias(c) for c in by]).agg(F.sum("sign").cast("bigint").alias("n"), *total)


def fold_changes(stored: DataFrame, events: DataFrame, by: list[str], sums: dict[str, Amount] | None = None, position: int = 0) -> DataFrame:
    """``stored`` (by..., n, sums...) after ``events``, groups without rows left out.

    ``position`` is the last ``seq`` that ``stored`` has seen: events at or before
    it are ignored, and repeated deliveries count once, so a batch may come
    again. A group with more rows taken away than it has fails the job: the log
    does not follow the stored state. NULL is a group like any other; NULL
    amounts count as nothing.
    """
    change = deltas(once_each(events.filter(F.col("seq") > position)), by, sums)
    names = list(sums or {})
    both = stored.select(*by, "n", *names).unionByName(change).groupBy(*by).agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    fail = F.raise_error(F.lit("more rows of a group changed away than it has")).cast("boolean")
    return both.filter(F.when(F.col("n") < 0, fail).otherwise(F.col("n") > 0))

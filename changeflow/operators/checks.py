"""Constraint checks. Each returns the offending rows (empty = clean); none loops on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """CHK-1: rows with a NULL in any of ``cols``."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """CHK-2: key values held by more than one row, with their count ``n``.

    Grouping aggregates partially per task first, so a key that holds a third
    of the rows reaches its reducer as one partial count per map task.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def uniques(frames: dict, keys: list[tuple[str, list[str]]]) -> DataFrame:
    """CHK-2 over a whole model: the repeated values of every declared key and unique index, one frame.

    Rows are (index, value, n): ``table(columns)``, the columns as JSON text and
    how often they occur. NULLs are compared as values, as a unique index does
    where it admits one.
    """
    parts = [unique(frames[t], cols).select(
        F.lit(f"{t}({','.join(cols)})").alias("index"), F.to_json(F.struct(*cols)).alias("value"), "n") for t, cols in keys]
    return reduce(DataFrame.unionByName, parts)


def foreign_key(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """CHK-3: child rows whose non-NULL reference has no parent (orphans).

    A NULL reference passes (a nullable FK). The referenced columns are a key of
    the parent, so they are joined as they are.
    """
    fks = [fk for fk, _ in on]
    refs = parent.select(*[F.col(pk).alias(fk) for fk, pk in on])
    has_ref = reduce(lambda a, b: a & b, [F.col(fk).isNotNull() for fk in fks])
    return child.filter(has_ref).join(refs, fks, "left_anti")


# Words of a reference filter: 64 bits each, so the filter is at most 1 MiB whatever the batch.
FILTER_WORDS = 65_536
FILTER_BITS = 4


def _filter_place(cols: list[str]) -> tuple[Column, Column]:
    """The word of a filter that a key falls into, and its bits there."""
    bits = F.xxhash64(F.lit(1), *cols)
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.xxhash64(*cols), F.lit(FILTER_WORDS)), reduce(Column.bitwiseOR, [one(k) for k in range(FILTER_BITS)])


def referenced(parent: DataFrame, batch: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """The keys of ``parent`` that rows of ``batch`` may refer to, named as the references: all that are, and few others.

    The batch's references are summed up in a Bloom filter of one 64-bit word a
    hash bucket, built by an aggregate of at most FILTER_WORDS rows, and probed
    in the parent's scan. References of the same value need the same type on both sides.
    """
    fks = [fk for fk, _ in on]
    word, bits = _filter_place(fks)
    words = batch.dropna(subset=fks).select(word.alias("_w"), bits.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_held"))
    keys = parent.select(*[F.col(pk).cast(batch.schema[fk].dataType).alias(fk) for fk, pk in on])
    word, bits = _filter_place(fks)
    probed = keys.withColumns({"_w": word, "_b": bits}).join(F.broadcast(words), "_w")
    return probed.filter(F.col("_held").bitwiseAND(F.col("_b")) == F.col("_b")).select(*fks)


def foreign_key_batch(batch: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """CHK-3 for a batch against a parent of any size: the orphans that ``foreign_key`` finds.

    Only parent keys that pass the filter of the batch's references reach the
    join, so what is exchanged follows the batch and not the parent. A key that
    passes by chance costs a row in the join and changes nothing.
    """
    return foreign_key(batch, referenced(parent, batch, on), [(fk, fk) for fk, _ in on])


def foreign_keys(frames: dict, fks: list[tuple[str, str, str, str]]) -> DataFrame:
    """CHK-3 over a whole model: orphans of every declared foreign key, one frame.

    Rows are (fk, child_row, ref): the constraint name ``child.column->parent``,
    the child's row as JSON text and the unresolved reference. Each constraint is
    one anti join against the parent's keys; the union keeps them apart.
    """
    parts = []
    for child, col, parent, pcol in fks:
        orphans = foreign_key(frames[child], frames[parent], [(col, pcol)])
        parts.append(orphans.select(
            F.lit(f"{child}.{col}->{parent}").alias("fk"),
            F.to_json(F.struct(*[F.col(c) for c in frames[child].columns])).alias("child_row"),
            F.col(col).cast("string").alias("ref"),
        ))
    return reduce(DataFrame.unionByName, parts)


def fill_defaults(df: DataFrame, spec: dict[str, Column]) -> DataFrame:
    """CHK-4: ``DEFAULT`` values for columns that are absent from the input.

    A column that is present keeps its values, NULLs included: a default fills
    a missing column, never an explicit NULL.
    """
    out = df
    for col, value in spec.items():
        if col not in df.columns:
            out = out.withColumn(col, value)
    return out


def max_length(df: DataFrame, col: str, n: int) -> DataFrame:
    """CHK-5: rows whose text is longer than ``n`` characters (NVARCHAR(n))."""
    return df.filter(F.char_length(F.col(col)) > F.lit(n))


def required(df: DataFrame, col: str) -> DataFrame:
    """CHK-6: rows whose required text field is NULL or empty."""
    return df.filter(F.coalesce(F.col(col), F.lit("")) == F.lit(""))

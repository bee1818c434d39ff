"""CAP-2 by digests: only the key ranges whose content differs are compared row by row.

Every key range of a version has a digest: row count, xor and sum of row
hashes, all of which combine in any order. Ranges are met on two levels, groups
of ranges first, so that of a table of which little changed few digests and
few rows take part in a join. Digests can be stored with their version; then a
capture reads nothing of the ranges that agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.operators.capture import capture
from changeflow.session import broadcast_if_bounded, settle

# Ranges in a group of the upper level, and hash ranges of keys that are not one integer.
FANOUT = 64
HASH_RANGES = 65_536


def key_range(df: DataFrame, key: list[str], width: int) -> Column:
    """The range of a row: ``width`` consecutive integers, or a hash range for other keys."""
    if len(key) == 1 and isinstance(df.schema[key[0]].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        k = F.col(key[0]).cast("bigint")
        return F.call_function("div", k - F.pmod(k, F.lit(width)), F.lit(width))
    return F.pmod(F.xxhash64(*key), F.lit(HASH_RANGES))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns in which a NULL differs from every value; maps go through JSON."""
    parts = []
    for f in df.schema.fields:
        c = F.to_json(F.col(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name)
        parts += [c, F.col(f.name).isNull()]
    return F.xxhash64(*parts)


def range_digests(df: DataFrame, key: list[str], width: int) -> DataFrame:
    """(range, n, x, s) of every key range: rows, xor of row hashes, sum of their low halves.

    One pass with partial aggregation: a task hands on one row a range.
    """
    h = df.select(key_range(df, key, width).alias("range"), row_hash(df).alias("h"))
    return h.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))


def _differing(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Values of ``by`` whose digests differ, those on one side only included."""
    o, n = old.alias("o"), new.alias("n")
    same = F.col("o.n").eqNullSafe(F.col("n.n")) & F.col("o.x").eqNullSafe(F.col("n.x")) & F.col("o.s").eqNullSafe(F.col("n.s"))
    return o.join(n, F.col(f"o.{by}") == F.col(f"n.{by}"), "full_outer").filter(~same).select(F.coalesce(f"o.{by}", f"n.{by}").alias(by))


def changed_ranges(old: DataFrame, new: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The ranges in which two sets of ``range_digests`` differ; only differing groups of ``fanout`` ranges are opened."""

    def grouped(d: DataFrame) -> DataFrame:
        return d.withColumn("group", F.floor(F.col("range") / fanout))

    def upper(d: DataFrame) -> DataFrame:
        return d.groupBy("group").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))

    o, n = grouped(old), grouped(new)
    groups = settle(_differing(upper(o), upper(n), "group"), "changed-groups")
    side = broadcast_if_bounded(groups)
    return _differing(o.join(side, "group", "left_semi"), n.join(side, "group", "left_semi"), "range")


def rows_of(df: DataFrame, key: list[str], width: int, ranges: DataFrame) -> DataFrame:
    """The rows of ``df`` in ``ranges``, filtered in the scan's stage while the list of ranges is small."""
    side = broadcast_if_bounded(ranges.select(F.col("range").alias("_r")))
    return df.join(side, key_range(df, key, width) == F.col("_r"), "left_semi")


def capture_by_digest(old: DataFrame, new: DataFrame, table: str, key: list[str], seq: int, width: int, commit_ts: str | None = None,
                      fanout: int = FANOUT, old_digests: DataFrame | None = None, new_digests: DataFrame | None = None) -> DataFrame:
    """The events of ``capture(old, new, ...)``, joining only the rows of ranges whose digests differ.

    Stored digests of either version (``range_digests`` with the same ``key``
    and ``width``) save its first pass. Both versions need the same columns; two
    different contents of a range with equal count, xor and sum of 64-bit hashes
    would be taken for equal.
    """
    new = new.select(*old.columns)
    digests = [settle(range_digests(df, key, width), "digests") if d is None else d for df, d in ((old, old_digests), (new, new_digests))]
    ranges = settle(changed_ranges(*digests, fanout), "changed-ranges")
    return capture(rows_of(old, key, width, ranges), rows_of(new, key, width, ranges), table, key, seq, commit_ts)

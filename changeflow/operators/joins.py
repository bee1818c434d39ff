"""Reference lookups along foreign keys (JN-5) and existence tests (JN-2..4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.session import DEFAULT_BROADCAST_BYTES, broadcast_if_bounded


def lookup(df: DataFrame, parent: DataFrame, on: list[tuple[str, str]], take: list[str],
           max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """JN-5: left join a parent along a foreign key and bring ``take`` columns.

    The parent is reduced to its key and the wanted columns first (pruning
    reaches its scan). It is broadcast only when Catalyst's size estimate of
    that projection is under ``max_broadcast_bytes``; a larger parent stays a
    sort-merge join that AQE may still convert from measured sizes.
    """
    p = parent.select(*[F.col(pk).alias(f"_p_{pk}") for _, pk in on], *take)
    p = broadcast_if_bounded(p, max_broadcast_bytes)
    cond = [F.col(fk) == F.col(f"_p_{pk}") for fk, pk in on]
    return df.join(p, cond, "left").drop(*[f"_p_{pk}" for _, pk in on])


def exists_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """JN-2: ``WHERE EXISTS (SELECT 1 FROM other WHERE keys match)``: left semi join."""
    return df.join(other.select(*on), on, "left_semi")


def absent_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """JN-3: ``WHERE NOT EXISTS (...)``: left anti join (the IF NOT EXISTS guard)."""
    return df.join(other.select(*on), on, "left_anti")

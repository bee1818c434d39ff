"""Small expression builders used across operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def same(a: Column | str, b: Column | str) -> Column:
    """Null-safe equality (``IS NOT DISTINCT FROM``)."""
    return _c(a).eqNullSafe(_c(b))


def changed(pairs: list[tuple[Column, Column]]) -> Column:
    """True when any pair differs null-safely; False for an empty list."""
    if not pairs:
        return F.lit(False)
    return reduce(lambda acc, p: acc | ~same(p[0], p[1]), pairs[1:], ~same(*pairs[0]))


def schema_of(table: Column | str) -> Column:
    """Schema part of a dotted name: second to last part (``db.schema.t`` or ``schema.t``);
    NULL for a one-part name (``try_element_at``: no error under ANSI)."""
    return F.try_element_at(F.split(_c(table), "[.]"), F.lit(-2))


def database_of(table: Column | str) -> Column:
    """Database part: first of three parts, or first of MongoDB's two (``db.collection``)."""
    return F.element_at(F.split(_c(table), "[.]"), 1)


def ts_ntz(text: str) -> Column:
    """A TIMESTAMP_NTZ literal (what PostgreSQL TIMESTAMP and DATETIME2 map to)."""
    return F.lit(text).cast("timestamp_ntz")

"""Reproducible random draws.

``rand(seed)`` depends on how rows fall into partitions, so a seed table would
change with the cluster layout. Instead every draw is a pure function of the
row number ``n`` and a salt: the first 32 bits of ``md5(n || ':' || salt)``.
All arithmetic on the draw is integer arithmetic, so DuckDB computes the same
values bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296
HALF_32 = 2147483648


def draw_u32(n: Column | str, salt: str) -> Column:
    """Uniform integer in [0, 2^32) determined by (n, salt)."""
    n = F.col(n) if isinstance(n, str) else n
    digest = F.md5(F.concat(n.cast("string"), F.lit(":" + salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def draw_below(n: Column | str, salt: str, k: int) -> Column:
    """``floor(U * k)`` for U = u32 / 2^32: uniform integer in [0, k)."""
    return F.shiftright(draw_u32(n, salt) * F.lit(k), 32)


def draw_round_cents(n: Column | str, salt: str, lo: int, span: int, precision: int = 10) -> Column:
    """``ROUND(U * span + lo, 2)`` as DECIMAL(precision, 2), rounding half up."""
    cents = F.lit(lo * 100) + F.shiftright(draw_u32(n, salt) * F.lit(span * 100) + F.lit(HALF_32), 32)
    return (cents / F.lit(100.0)).cast(f"decimal({precision},2)")


def rint_flag(n: Column | str, salt: str) -> Column:
    """``(U * 2)::INT == 0`` with round-half-even, i.e. U <= 1/4 (one chance in four)."""
    return draw_u32(n, salt) <= F.lit(TWO_32 // 4)

"""Column-level helpers; every one is a built-in Spark expression (codegen, no UDF)."""

from changeflow.functions.draws import draw_below, draw_round_cents, draw_u32, rint_flag
from changeflow.functions.expressions import (
    changed,
    database_of,
    same,
    schema_of,
    ts_ntz,
)

__all__ = [
    "draw_u32",
    "draw_below",
    "draw_round_cents",
    "rint_flag",
    "changed",
    "same",
    "schema_of",
    "database_of",
    "ts_ntz",
]

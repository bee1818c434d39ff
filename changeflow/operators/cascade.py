"""MUT-6 over a whole graph of declared references, CASCADE and RESTRICT mixed."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.session import broadcast_if_bounded, settle

CASCADE, RESTRICT = "cascade", "restrict"


class Reference(NamedTuple):
    """``columns`` of ``child`` hold the key of ``parent``; ``action`` is what a delete of the parent's row does."""

    child: str
    columns: list[str]
    parent: str
    action: str


def parents_first(tables: list[str], references: list[Reference]) -> list[str]:
    """``tables`` so that parents come before children; a cycle of several tables is an error, a table may refer to itself."""
    waits = {t: {r.parent for r in references if r.child == t and r.parent != t} for t in tables}
    order: list[str] = []
    while len(order) < len(tables):
        ready = [t for t in tables if t not in order and waits[t] <= set(order)]
        if not ready:
            raise ValueError(f"references form a cycle: {sorted(set(tables) - set(order))}")
        order += ready
    return order


def _referring(rows: DataFrame, ref: Reference, gone: DataFrame, parent_key: list[str], how: str) -> DataFrame:
    side = broadcast_if_bounded(gone.select(*[F.col(k).alias(c) for k, c in zip(parent_key, ref.columns)]))
    return rows.join(side, ref.columns, how)


def deleted_keys(tables: dict[str, DataFrame], keys: dict[str, list[str]], references: list[Reference], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The keys of every table that go when the keys ``gone`` are deleted, along all CASCADE references.

    Tables are taken parents first, so each is read once however many paths lead
    to it; a table that refers to itself is followed until no new key turns up.
    Each table's set is written before the next, so plans do not grow with depth.
    """
    out: dict[str, DataFrame] = {}
    for name in parents_first(list(tables), references):
        rows, key = tables[name], keys[name]
        cascades = [r for r in references if r.child == name and r.action == CASCADE]
        found = [gone[name].select(*key)] if name in gone else []
        found += [_referring(rows, r, out[r.parent], keys[r.parent], "left_semi").select(*key) for r in cascades if r.parent != name]
        if not found:
            out[name] = rows.select(*key).limit(0)
            continue
        whole = settle(reduce(DataFrame.unionByName, found).distinct(), f"deleted-{name}")
        latest, own = whole, [r for r in cascades if r.parent == name]
        while own and not latest.isEmpty():
            more = reduce(DataFrame.unionByName, [_referring(rows, r, latest, key, "left_semi").select(*key) for r in own])
            latest = settle(more.distinct().join(whole, key, "left_anti"), f"deleted-{name}")
            whole = settle(whole.unionByName(latest), f"deleted-{name}")
        out[name] = whole
    return out


def delete_cascading(tables: dict[str, DataFrame], keys: dict[str, list[str]], references: list[Reference], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without the rows that ``gone`` deletes (MUT-6).

    A row that stays and refers over a RESTRICT reference to a row that goes
    fails the job, from inside its table's plan; rows that go themselves hold
    nobody back. A NULL reference refers to nothing.
    """
    lost = deleted_keys(tables, keys, references, gone)
    out = {}
    for name, rows in tables.items():
        left = rows.join(broadcast_if_bounded(lost[name]), keys[name], "left_anti")
        for r in references:
            if r.child == name and r.action == RESTRICT:
                marked = lost[r.parent].withColumn("_held", F.lit(True))
                side = broadcast_if_bounded(marked.select(*[F.col(k).alias(c) for k, c in zip(keys[r.parent], r.columns)], "_held"))
                fail = F.raise_error(F.concat(F.lit(f"{name} still refers to a deleted row of {r.parent}: "), F.concat_ws(",", *[F.col(c).cast("string") for c in r.columns])))
                # The row number (always >= 0) keeps the optimizer from judging the filter beforehand.
                held = F.col("_held").isNotNull() & (F.monotonically_increasing_id() >= 0)
                left = left.join(side, r.columns, "left").filter(F.when(held, fail.cast("boolean")).otherwise(F.lit(True))).drop("_held")
        out[name] = left.select(*rows.columns)
    return out

"""Event transforms: include lists, conditional transforms, unwrap, tombstones,
topic routing, keys, strict lookups and JSON parsing.

All are narrow projections or filters (no shuffle) except ``strict_lookup``,
which is one join.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.expressions import database_of, schema_of

Transform = Callable[[DataFrame], DataFrame]


def include_tables(events: DataFrame, tables: list[str], column: str = "table") -> DataFrame:
    """FLT-1: ``table.include.list`` / ``collection.include.list``.

    Applied on the cheap name column before any payload parsing; on a landing
    folder partitioned by ``table`` the filter prunes whole directories.
    """
    return events.filter(F.col(column).isin(list(tables)))


def include_schemas(events: DataFrame, schemas: list[str], column: str = "table") -> DataFrame:
    """FLT-2: ``schema.include.list`` (second to last part of the dotted name)."""
    return events.filter(schema_of(column).isin(list(schemas)))


def include_databases(events: DataFrame, databases: list[str], column: str = "table") -> DataFrame:
    """FLT-2: ``database.include.list`` (first part of the dotted name)."""
    return events.filter(database_of(column).isin(list(databases)))


def transform_if(
    df: DataFrame,
    f: Callable[[DataFrame], dict[str, Column]],
    predicate: Column | None = None,
    negate: bool = False,
) -> DataFrame:
    """FLT-8: apply a column transform only to rows matching ``predicate``.

    ``f`` returns new expressions for some columns; rows where the (possibly
    negated) predicate holds get them, others keep their values. A NULL
    predicate result counts as false before negation; no predicate means
    "always".
    """
    new_cols = f(df)
    hit = F.lit(True) if predicate is None else (F.coalesce(predicate, F.lit(False)) != F.lit(negate))
    return df.select(
        *[(F.when(hit, new_cols[c]).otherwise(F.col(c)) if c in new_cols else F.col(c)).alias(c) for c in df.columns]
    )


def chain(df: DataFrame, transforms: list[Transform]) -> DataFrame:
    """FLT-9: the ordered transform list of a flow; empty means identity."""
    return reduce(lambda acc, t: acc.transform(t), transforms, df)


def unwrap(events: DataFrame, deletes: str = "drop") -> DataFrame:
    """CAP-5: keep the new row state (``after.*``) of each event.

    ``deletes`` decides what a delete event becomes:
    ``"drop"`` removes it; ``"null"`` keeps its key with NULL values;
    ``"rewrite"`` keeps its last state (``before.*``) and adds ``__deleted``
    (``"true"`` for deletes, ``"false"`` otherwise).
    """
    after_fields = events.schema["after"].dataType.fieldNames()
    key_fields = events.schema["key"].dataType.fieldNames()
    if deletes not in ("drop", "null", "rewrite"):
        raise ValueError(f"deletes must be 'drop', 'null' or 'rewrite', not {deletes!r}")
    ev = events.filter(F.col("op") != "d") if deletes == "drop" else events
    is_del = F.col("op") == "d"

    def value(c: str) -> Column:
        v = F.when(is_del, F.col(f"before.{c}")).otherwise(F.col(f"after.{c}")) if deletes == "rewrite" \
            else F.col(f"after.{c}")
        return F.coalesce(v, F.col(f"key.{c}")) if c in key_fields else v

    cols = [value(c).alias(c) for c in after_fields]
    if deletes == "rewrite":
        cols.append(F.when(is_del, F.lit("true")).otherwise(F.lit("false")).alias("__deleted"))
    return ev.select(*cols, "op", "seq")


def tombstones(events: DataFrame, on: bool) -> DataFrame:
    """CAP-6: ``tombstones.on.delete``.

    Adds ``is_tombstone``. On: each ``d`` event is followed by a record with the
    same key and a NULL value (``explode`` of a 1- or 2-element array: a narrow
    operation). Off: identity plus the flag column, always false.
    """
    if not on:
        return events.withColumn("is_tombstone", F.lit(False))
    marks = F.when(F.col("op") == "d", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    exploded = events.withColumn("is_tombstone", F.explode(marks))
    payload = [c for c in events.columns if c not in ("table", "op", "key", "seq", "commit_ts")]
    return exploded.select(
        *[F.when(~F.col("is_tombstone"), F.col(c)).alias(c) if c in payload else F.col(c) for c in events.columns],
        "is_tombstone",
    )


def route(events: DataFrame, prefix: str, column: str = "table") -> DataFrame:
    """CAP-7: ``topic.prefix``: topic = prefix '.' table name."""
    return events.withColumn("topic", F.concat_ws(".", F.lit(prefix), F.col(column)))


def event_key(events: DataFrame, key_col: str = "key") -> DataFrame:
    """CAP-8: the record key as JSON text of the primary-key struct."""
    return events.withColumn("key_json", F.to_json(F.col(key_col)))


def per_key_order(events: DataFrame, key_col: str = "key", seq_col: str = "seq") -> DataFrame:
    """Delivery order: all events of a key in one task, ascending ``seq``.

    Needed only for full-fidelity feeds written to a keyed log (a consumer
    must see a key's events in order). A net-change feed has at most one event
    per key and needs no ordering, so hot keys there never meet in one task.
    """
    return events.repartition(F.col(key_col)).sortWithinPartitions(key_col, seq_col)


def strict_lookup(df: DataFrame, dim: DataFrame, on: list[tuple[str, str]], take: list[str],
                  what: str = "reference") -> DataFrame:
    """JN-6: left join that fails the job when a reference does not resolve.

    ``raise_error`` runs inside a filter that no projection can prune, so the
    failure surfaces in the task that meets the first unresolved row, whatever
    columns are read; nothing is collected to check.
    """
    probe = "_dim_present"
    d = dim.select(*[F.col(dk).alias(f"_dim_{dk}") for _, dk in on], *take, F.lit(True).alias(probe))
    cond = [F.col(fk) == F.col(f"_dim_{dk}") for fk, dk in on]
    j = df.join(d, cond, "left")
    fail = F.raise_error(F.concat(F.lit(f"unresolved {what}: "), F.concat_ws(",", *[F.col(fk).cast("string") for fk, _ in on])))
    # The row number (always >= 0) keeps the optimizer from judging the filter on a NULL probe beforehand.
    missing = F.col(probe).isNull() & (F.monotonically_increasing_id() >= 0)
    return j.filter(F.when(missing, fail.cast("boolean")).otherwise(F.lit(True))).select(*df.columns, *take)


def to_mixed(events: DataFrame) -> DataFrame:
    """Typed events of one table into the mixed-table shape (``schemas.MIXED_EVENT``):
    key, before and after travel as JSON text, so many tables share one landing."""
    return events.select(
        "table", "op",
        F.to_json(F.col("key")).alias("key"),
        F.to_json(F.col("before")).alias("before"),
        F.to_json(F.col("after")).alias("after"),
        "commit_ts", "seq",
    )


def from_mixed(mixed: DataFrame, table: str, key_schema, row_schema) -> DataFrame:
    """Route one table out of a mixed stream and type its payloads.

    The table filter runs on the plain name column first (and prunes landed
    ``table=`` folders); only that table's JSON is parsed, with its declared
    schema, never inferred.
    """
    return include_tables(mixed, [table]).select(
        "table", "op",
        F.from_json(F.col("key"), key_schema).alias("key"),
        F.from_json(F.col("before"), row_schema).alias("before"),
        F.from_json(F.col("after"), row_schema).alias("after"),
        "commit_ts", "seq",
    )


def parse_json_object(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """DER-5: parse a JSON text column into a typed struct (no inference)."""
    return df.withColumn(column, F.from_json(F.col(column), ddl))


def parse_json_array(df: DataFrame, column: str, element: str = "string") -> DataFrame:
    """DER-5: a JSON array stored as text (``tags``) into ``array<element>``."""
    return df.withColumn(column, F.from_json(F.col(column), f"array<{element}>"))

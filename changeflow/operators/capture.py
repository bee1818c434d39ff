"""Change capture: snapshots, version diffs, snapshot/log hand-off, net changes.

Events follow ``schemas.event_schema``: table, op, key, before, after,
commit_ts, seq. ``key``/``before``/``after`` are structs of the captured
table's own column types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions.expressions import changed
from changeflow.session import broadcast_if_bounded


def _row(df: DataFrame, cols: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def _null_like(struct_col: Column) -> Column:
    """A NULL with the type of ``struct_col`` (no literal type spelled out)."""
    return F.when(F.lit(False), struct_col)


def _commit_ts(commit_ts: str | None) -> Column:
    return F.lit(commit_ts).cast("timestamp") if commit_ts else F.lit(None).cast("timestamp")


def snapshot(df: DataFrame, table: str, key: list[str], seq: int, commit_ts: str | None = None) -> DataFrame:
    """CAP-1: every row of the table as an ``r`` event at position ``seq``.

    A pure projection: no shuffle, partitioning of the scan is kept.
    """
    cols = df.columns
    after = _row(df, cols)
    return df.select(
        F.lit(table).alias("table"),
        F.lit("r").alias("op"),
        _row(df, key).alias("key"),
        _null_like(after).alias("before"),
        after.alias("after"),
        _commit_ts(commit_ts).alias("commit_ts"),
        F.lit(seq).cast("bigint").alias("seq"),
    )


def capture(
    old: DataFrame,
    new: DataFrame,
    table: str,
    key: list[str],
    seq: int,
    commit_ts: str | None = None,
) -> DataFrame:
    """CAP-2: row changes between two versions of a table.

    One full outer join on the key (each side shuffled once by key, or not at
    all when both are stored bucketed on it). Keys only in ``new`` are ``c``,
    only in ``old`` are ``d``; keys in both are ``u`` when any non-key column
    differs null-safely, and dropped otherwise.
    """
    cols = old.columns
    values = [c for c in cols if c not in key]
    # Both sides keep their own column names (qualified by alias): identical
    # inputs then plan identical exchanges, which Spark reuses across joins.
    o = old.select(*cols, F.lit(True).alias("_present")).alias("o")
    n = new.select(*cols, F.lit(True).alias("_present")).alias("n")
    cond = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    j = o.join(n, cond, "full_outer")
    o_here, n_here = F.col("o._present").isNotNull(), F.col("n._present").isNotNull()
    diff = changed([(F.col(f"o.{c}"), F.col(f"n.{c}")) for c in values])
    op = F.when(~o_here, F.lit("c")).when(~n_here, F.lit("d")).when(diff, F.lit("u"))
    before = F.struct(*[F.col(f"o.{c}").alias(c) for c in cols])
    after = F.struct(*[F.col(f"n.{c}").alias(c) for c in cols])
    key_struct = F.struct(*[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in key])
    return (
        j.select(
            F.lit(table).alias("table"),
            op.alias("op"),
            key_struct.alias("key"),
            F.when(o_here, before).alias("before"),
            F.when(n_here, after).alias("after"),
            _commit_ts(commit_ts).alias("commit_ts"),
            F.lit(seq).cast("bigint").alias("seq"),
        )
        .filter(F.col("op").isNotNull())
    )


def handoff(snapshot_events: DataFrame, log: DataFrame, snapshot_seq: int) -> DataFrame:
    """CAP-3: snapshot followed by the log, with no loss and no repeat.

    Log events at or before the snapshot position are already contained in the
    snapshot and are dropped; the filter reaches the log's scan.
    """
    return snapshot_events.unionByName(log.filter(F.col("seq") > F.lit(snapshot_seq)))


def _tie_hash(struct_col: Column, dt: T.DataType) -> Column:
    """A hash of an event's content; types without one (maps) go through JSON."""
    return F.xxhash64(F.to_json(struct_col)) if "map<" in dt.simpleString() else F.xxhash64(struct_col)


def _ranked(events: DataFrame) -> DataFrame:
    """Events with ``_at`` = (seq, content hash): repeated deliveries tie, different content does not."""
    content = F.struct("op", "before", "after")
    kind = events.select(content.alias("c")).schema["c"].dataType
    h = _tie_hash(content, kind)
    return events.withColumn("_at", F.struct(F.col("seq").alias("seq"), h.alias("h"))).withColumn(
        "_ta", F.struct(F.col("seq").alias("seq"), F.bitwise_not(h).alias("h")))


def _one(value: Column, hi: Column, lo: Column) -> Column:
    """``value``, or an error when the events at one position differ (``hi``/``lo``: largest hash and largest inverted hash)."""
    return F.when(hi == F.bitwise_not(lo), value).otherwise(F.raise_error(F.lit("change log has different events with equal seq for one key")))


def net_changes(events: DataFrame, drop_noop: bool = False) -> DataFrame:
    """CAP-4: reduce a closed interval of a log to at most one event per key.

    First and last op per key, ordered by ``seq``:
    (c, not d) -> c; (not c, not d) -> u; (not c, d) -> d; (c, d) -> none.
    ``r`` events are the starting rows and not part of the interval. Deliveries
    of one event repeated at one ``seq`` count once; different events at the
    first or last ``seq`` of a key cannot be ordered and fail the job.

    ``min_by``/``max_by`` aggregate partially before the shuffle, so a hot key
    arrives at its reducer as one row per map task, never as its raw events.
    With ``drop_noop`` a ``u`` whose first ``before`` equals its last ``after``
    (changed and changed back) is removed as well.
    """
    ev = _ranked(events.filter(F.col("op") != F.lit("r")))
    return _net(_summary(ev, "table", "key"), [], drop_noop)


def _summary(ranked: DataFrame, *by: str) -> DataFrame:
    """What a stretch of a log amounts to for each group: first op and row before, last op and row after, and the ends' positions.

    Summaries of neighbouring stretches merge into the summary of both (``_merged``).
    """
    return ranked.groupBy(*by).agg(
        F.min_by(F.struct("op", "before"), F.col("_at")).alias("_first"),
        F.max_by(F.struct("op", "after", "commit_ts"), F.col("_at")).alias("_last"),
        F.max("_at").alias("_hi"), F.max("_ta").alias("_lo"), F.min("_at").alias("_hi0"), F.min("_ta").alias("_lo0"),
    )


def _merged(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by).agg(
        F.min_by("_first", "_hi0").alias("_first"), F.max_by("_last", "_hi").alias("_last"),
        F.max("_hi").alias("_hi"), F.max("_lo").alias("_lo"), F.min("_hi0").alias("_hi0"), F.min("_lo0").alias("_lo0"),
    )


def _net(agg: DataFrame, extra: list[str], drop_noop: bool) -> DataFrame:
    """At most one event a summary, with the columns ``extra``."""
    first_op = _one(F.col("_first.op"), F.col("_hi0.h"), F.col("_lo0.h"))
    last_op = _one(F.col("_last.op"), F.col("_hi.h"), F.col("_lo.h"))
    agg = agg.withColumn("_fo", first_op).withColumn("_lo_op", last_op)
    first_op, last_op = F.col("_fo"), F.col("_lo_op")
    op = (
        F.when((first_op == "c") & (last_op != "d"), F.lit("c"))
        .when((first_op != "c") & (last_op != "d"), F.lit("u"))
        .when((first_op != "c") & (last_op == "d"), F.lit("d"))
    )
    out = agg.select(
        *extra,
        "table",
        op.alias("op"),
        "key",
        F.when(op != "c", F.col("_first.before")).alias("before"),
        F.when(op != "d", F.col("_last.after")).alias("after"),
        F.col("_last.commit_ts").alias("commit_ts"),
        F.col("_hi.seq").alias("seq"),
    ).filter(F.col("op").isNotNull())
    if drop_noop:
        out = out.filter(~((F.col("op") == "u") & F.col("before").eqNullSafe(F.col("after"))))
    return out


def net_changes_intervals(events: DataFrame, intervals: list[tuple[int, int]], drop_noop: bool = False) -> DataFrame:
    """CAP-4 for several intervals (after low, up to high) in one pass over the log, with the columns ``low`` and ``high``.

    The intervals' ends cut the log into stretches; each event goes into the
    summary of its stretch, once, and an interval merges the summaries of its
    stretches. So intervals may overlap, the log is read once, and what is
    exchanged does not grow with their number. Every interval's rows are those
    of ``net_changes`` over its events alone.
    """
    cuts = sorted({end for interval in intervals for end in interval})
    stretch = sum((F.when(F.col("seq") > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    ev = _ranked(events.filter((F.col("op") != F.lit("r")) & (F.col("seq") > cuts[0]) & (F.col("seq") <= cuts[-1])))
    parts = _summary(ev.withColumn("_stretch", stretch), "table", "key", "_stretch")
    own = F.array(*[F.struct(F.lit(lo).cast("bigint").alias("low"), F.lit(hi).cast("bigint").alias("high"),
                             F.lit(cuts.index(lo)).alias("a"), F.lit(cuts.index(hi)).alias("b")) for lo, hi in intervals])
    held = F.filter(own, lambda i: (F.col("_stretch") > i["a"]) & (F.col("_stretch") <= i["b"]))
    parts = parts.withColumn("_i", F.explode(held)).withColumn("low", F.col("_i.low")).withColumn("high", F.col("_i.high"))
    return _net(_merged(parts, "table", "key", "low", "high"), ["low", "high"], drop_noop)


def last_events(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The last event of each (table, key), unchanged: what a replay has to apply.

    With ``by`` (fields of the key, events of one table) the result is grouped by
    these as flat columns instead.

    Unlike ``net_changes`` a key created and deleted again keeps its ``d`` (the
    target may already hold the row, and late events need the marker), and
    snapshot rows (``r``) stay. Ties as in ``net_changes``.
    """
    last = F.struct("op", "before", "after", "commit_ts")
    ranked = _ranked(events)
    if by:
        ranked = ranked.select(*[F.col(f"key.{k}").alias(k) for k in by], *[c for c in ranked.columns if c not in ("table", "key")])
    names = by or ["table", "key"]
    agg = ranked.groupBy(*names).agg(
        F.max_by(last, F.col("_at")).alias("_last"), F.max("seq").alias("seq"), F.max("_at").alias("_hi"), F.max("_ta").alias("_lo"))
    return agg.select(*names, _one(F.col("_last.op"), F.col("_hi.h"), F.col("_lo.h")).alias("op"), F.col("_last.before").alias("before"),
                      F.col("_last.after").alias("after"), F.col("_last.commit_ts").alias("commit_ts"), "seq")


def require_ordered(events: DataFrame) -> None:
    """Reject a log whose ``seq`` is not unique per (table, key).

    Equal positions cannot be ordered, so they are an error, never broken
    arbitrarily. One partially aggregated pass over (table, key, seq); only a
    yes/no reaches the driver (``isEmpty`` stops at the first duplicate).
    """
    dup = (events.groupBy("table", "key", "seq").agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") > 1))
    if not dup.isEmpty():
        raise ValueError("change log has events with equal seq for one key")


def capture_candidates(tables: DataFrame, schemas: DataFrame, indexes: DataFrame, schema_name: str) -> DataFrame:
    """CAP-9: tables of one schema that have a primary key and are not tracked yet.

    JN-1 (tables join schemas), JN-2 (EXISTS primary-key index, a left semi
    join) and a filter replace the cursor loop over ``sys.tables``.
    """
    pk = indexes.filter(F.col("is_primary_key"))
    return (
        tables.join(schemas, "schema_id", "inner")
        .filter(F.col("schema_name") == F.lit(schema_name))
        .join(pk, "object_id", "left_semi")
        .filter(~F.col("is_tracked_by_cdc"))
    )


def capture_list_filter(events: DataFrame, capture_list: DataFrame, column: str = "table") -> DataFrame:
    """CAP-10: keep events of the tables on the capture list (a semi join).

    The list is a table, so it can be stored and replaced; it is broadcast when
    its estimated size is bounded.
    """
    return events.join(broadcast_if_bounded(capture_list.select(column).distinct()), column, "left_semi")


def replace_capture_list(lists: DataFrame | None, tables: DataFrame, seq: int, column: str = "table") -> DataFrame:
    """CAP-10: the stored list (from_seq, table) with ``tables`` as the whole list from position ``seq`` on.

    None as ``lists`` creates it. A NULL table marks each version, so that an
    empty list is a list too.
    """
    spark = tables.sparkSession
    names = tables.select(F.lit(seq).cast("bigint").alias("from_seq"), F.col(column).cast("string").alias(column)).distinct()
    version = names.unionByName(spark.range(1).select(F.lit(seq).cast("bigint").alias("from_seq"), F.lit(None).cast("string").alias(column)))
    return version if lists is None else lists.unionByName(version)


def capture_list_asof(events: DataFrame, lists: DataFrame, column: str = "table") -> DataFrame:
    """CAP-10 while the list changes: events of tables on the list in force at their own ``seq``.

    In force is the last version at or before the position; before the first
    version nothing is captured. Versions are control data (a row a table and
    replacement): each member gets the interval in which it holds, and events
    meet them in one equi-join on the table with the interval as its condition.
    """
    starts = lists.select("from_seq").distinct()
    starts = starts.withColumn("to_seq", F.lead("from_seq").over(Window.orderBy("from_seq")))
    members = lists.filter(F.col(column).isNotNull()).distinct().join(starts, "from_seq").withColumnRenamed(column, "_member")
    holds = (F.col(column) == F.col("_member")) & (F.col("seq") >= F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") < F.col("to_seq")))
    return events.join(broadcast_if_bounded(members), holds, "left_semi")

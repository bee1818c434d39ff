"""Keyed mutations: upsert family, deletes, cascade, id assignment, change replay.

Parquet has no MERGE, so every mutation is a set expression that produces
the next version of the table: one join on the key (each side shuffled once
by the key, or not at all when both sides are stored bucketed on it) and a
per-column choice between the old and the new value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.operators.capture import last_events, require_ordered
from changeflow.session import broadcast_if_bounded, settle


def _present(side: str) -> Column:
    return F.col(f"{side}._present").isNotNull()


def _tag(df: DataFrame, side: str) -> DataFrame:
    """Mark rows of one join side; columns keep their names, qualified by ``side``.

    Keeping the names means an input used by several joins (a table version
    in a capture and in a replay) plans the same exchange each time, and
    Spark reuses it instead of shuffling the input again.
    """
    return df.select(*df.columns, F.lit(True).alias("_present")).alias(side)


def _c(side: str, col: str) -> Column:
    return F.col(f"{side}.{col}")


def _unique_source(src: DataFrame, key: list[str]) -> DataFrame:
    """``src`` with a check that no key occurs twice; two rows of one key fail the job.

    The grouping is on the join key, so it shares the join's exchange.
    """
    rest = [c for c in src.columns if c not in key]
    one = src.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest) if rest else F.lit(1)).alias("_row"))
    fail = F.raise_error(F.concat(F.lit("duplicate source key: "), F.concat_ws(",", *[F.col(k).cast("string") for k in key])))
    one = one.filter(F.when(F.col("_n") > 1, fail.cast("boolean")).otherwise(F.lit(True)))
    return one.select(*[F.col(c) if c in key else F.col("_row").getField(c).alias(c) for c in src.columns])


def _least_row(src: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the least by its other columns in their order (nulls first)."""
    rest = [c for c in src.columns if c not in key]
    if not rest:
        return src.select(*key).distinct()
    one = src.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row"))
    return one.select(*[F.col(c) if c in key else F.col("_row").getField(c).alias(c) for c in src.columns])


def _keyed_full_join(target: DataFrame, src: DataFrame, key: list[str]) -> DataFrame:
    t, s = _tag(target, "t"), _tag(src, "s")
    return t.join(s, [_c("t", k) == _c("s", k) for k in key], "full_outer")


def upsert(
    target: DataFrame,
    src: DataFrame,
    key: list[str],
    set_cols: list[str],
    defaults: dict[str, Column] | None = None,
    touch: dict[str, Column] | None = None,
) -> DataFrame:
    """MUT-1 / MUT-2: ``INSERT ... ON CONFLICT (key) DO UPDATE SET set_cols``.

    * key only in target: row kept as is;
    * key in both: columns in ``set_cols`` take the source value, ``touch``
      columns take their expression (``updated_at = NOW()``), all others keep
      the old value;
    * key only in source: source values, and ``defaults`` (else NULL) for the
      columns the source does not carry.
    Output has the target's columns plus any ``touch`` column it lacks. A source
    with two rows of one key fails the job, as the statement would.
    """
    src = _unique_source(src, key)
    defaults, touch = defaults or {}, touch or {}
    types = {f.name: f.dataType for f in target.schema.fields}
    out_cols = list(target.columns) + [c for c in touch if c not in target.columns]
    target = target.select(*target.columns, *[F.lit(None).alias(c) for c in touch if c not in target.columns])
    j = _keyed_full_join(target, src, key)
    in_t, in_s = _present("t"), _present("s")
    matched = in_t & in_s
    exprs = []
    for c in out_cols:
        old = _c("t", c)
        new = _c("s", c) if c in src.columns else defaults.get(c, F.lit(None))
        if c in key:
            e = F.coalesce(_c("t", c), _c("s", c))
        else:
            on_match = touch[c] if c in touch else (_c("s", c) if c in set_cols else old)
            e = F.when(matched, on_match).when(in_t, old).otherwise(new)
        exprs.append((e.cast(types[c]) if c in types and c not in touch else e).alias(c))
    return j.select(*exprs)


def doc_upsert(
    target: DataFrame,
    src: DataFrame,
    key: list[str],
    set_fields: list[str],
    set_on_insert: dict[str, Column] | list[str] | None = None,
) -> DataFrame:
    """MUT-3: document upsert with ``$set`` and ``$setOnInsert``.

    ``$set`` fields replace the stored value whole (an embedded struct is not
    merged field by field; an explicit NULL is stored); fields not named keep
    their value; ``$setOnInsert`` applies only to new keys, with either fixed
    expressions (dict) or the source's own values (list of field names). A
    field the target does not have yet widens the output (NULL on untouched
    documents). Two source documents of one key fail the job.
    """
    if isinstance(set_on_insert, (list, tuple)):
        set_on_insert = {c: _c("s", c) for c in set_on_insert}
        from_src = list(set_on_insert)
    else:
        set_on_insert, from_src = set_on_insert or {}, []
    out_cols = list(target.columns)
    for c in list(set_fields) + list(set_on_insert):
        if c not in out_cols:
            out_cols.append(c)
    src_sel = src.select(*key, *[c for c in list(set_fields) + from_src if c not in key])
    j = _keyed_full_join(target, _unique_source(src_sel, key), key)
    in_t, in_s = _present("t"), _present("s")
    exprs = []
    for c in out_cols:
        old = _c("t", c) if c in target.columns else F.lit(None)
        if c in key:
            e = F.coalesce(_c("t", c), _c("s", c))
        elif c in set_fields:
            e = F.when(in_s, _c("s", c)).otherwise(old)
        elif c in set_on_insert:
            e = F.when(in_t, old).otherwise(set_on_insert[c])
        else:
            e = F.when(in_t, old)
        exprs.append(e.alias(c))
    return j.select(*exprs)


def insert_if_absent(target: DataFrame, src: DataFrame, key: list[str]) -> DataFrame:
    """MUT-4: add source rows whose key is new; an existing row wins untouched.

    Of several source rows with one new key the least by its other columns is added.
    """
    new_rows = _least_row(src, key).join(target.select(*key), key, "left_anti")
    return target.unionByName(new_rows.select(*target.columns))


def find_or_create(target: DataFrame, src: DataFrame, match: list[str], id_col: str,
                   start: int | None = None) -> tuple[DataFrame, DataFrame]:
    """MUT-4 with ids: find each source row's existing row by ``match``, or create it.

    Returns ``(resolved, table)``: the source rows with the id of the row they
    resolved to (existing rows win and are not updated), and the target plus
    the created rows. New rows get SERIAL-style ids after the current maximum
    (``next_id``), in ``match`` order, one per distinct match value, so
    repeated source rows share one id; of those the least by its other columns
    becomes the created row. A NULL match value names no row: it fails the job.
    """
    start = next_id(target, id_col) if start is None else start
    nameless = reduce(Column.__or__, [F.col(c).isNull() for c in match])
    fail = F.raise_error(F.lit(f"NULL match value in {','.join(match)}")).cast("boolean")
    src = src.filter(F.when(nameless, fail).otherwise(F.lit(True)))
    fresh = src.select(*match).distinct().join(target.select(*match), match, "left_anti")
    created_ids = assign_ids(fresh, start, match, id_col)
    ids = target.select(*match, id_col).unionByName(created_ids)
    resolved = src.join(ids, match, "left")
    created = created_ids.join(_least_row(src, match), match, "inner")
    table = target.unionByName(created.select(*target.columns))
    return resolved, table


def delete_keys(target: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """MUT-5: remove the rows whose key is in ``keys`` (a left anti join)."""
    return target.join(keys.select(*key), key, "left_anti")


def restrict_delete(parent: DataFrame, keys: DataFrame, key: list[str], children: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """MUT-6 without a cascade: remove the rows of ``keys`` unless a child refers to one of them, which fails the job.

    ``children`` pairs each referring table with its reference columns. Each is
    reduced to the deleted keys it uses before it meets the parent, so rows that
    matter to no deletion are dropped where they are read.
    """
    gone = keys.select(*key)
    for child, fk in children:
        used = child.select(*[F.col(c).alias(k) for c, k in zip(fk, key)]).join(gone, key, "left_semi").groupBy(*key).agg(F.lit(True).alias("_used"))
        fail = F.raise_error(F.concat(F.lit("row is still referenced: "), F.concat_ws(",", *[F.col(k).cast("string") for k in key])))
        # The row number (always >= 0) keeps the optimizer from judging the filter on a NULL beforehand.
        held = F.col("_used").isNotNull() & (F.monotonically_increasing_id() >= 0)
        parent = parent.join(used, key, "left").filter(F.when(held, fail.cast("boolean")).otherwise(F.lit(True))).drop("_used")
    return parent.join(gone, key, "left_anti")


def cascade_delete(child: DataFrame, deleted_parent_keys: DataFrame, fk: list[str], parent_key: list[str]) -> DataFrame:
    """MUT-6: ``ON DELETE CASCADE``: child rows of deleted parents go too."""
    keys = deleted_parent_keys.select(*[F.col(p).alias(f) for p, f in zip(parent_key, fk)])
    return child.join(keys, fk, "left_anti")


def next_id(existing: DataFrame, id_col: str) -> int:
    """The SERIAL continuation: ``setval(seq, COALESCE(MAX(id), 1), true)`` + 1.

    An empty table therefore continues at 2, not 1 (the sequence is set to 1
    with ``is_called = true``). One scalar aggregate; partial max per task.
    """
    return int(existing.agg(F.coalesce(F.max(id_col), F.lit(1)).alias("m")).first()["m"]) + 1


def assign_ids(df: DataFrame, start: int, order_by: list[str], id_col: str = "id",
               partitions: int | None = None) -> DataFrame:
    """MUT-8: dense ids ``start, start+1, ...`` following the order of ``order_by``.

    No un-partitioned window over the rows: the frame is range-partitioned and
    sorted within partitions once, and written with each row's partition and
    position. Row counts per partition, taken from that same written frame,
    become offsets; an id is its partition's offset plus its position.
    ``order_by`` must be unique, which makes the ids deterministic.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(n, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    )
    ranged = settle(ranged, "assign_ids")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_pid",
        (F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    )
    # ``offsets`` has one row per partition: its size is bounded by ``n``.
    return ranged.join(F.broadcast(offsets), "_pid", "inner").select(
        *df.columns,
        (F.lit(start) + F.coalesce(F.col("_off"), F.lit(0)) + F.col("_pos")).cast("bigint").alias(id_col),
    )


def number_within(df: DataFrame, group: list[str], order_by: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name``: consecutive numbers from ``start`` within each group, following ``order_by``.

    As ``assign_ids``, for many groups at once: one range exchange on (group,
    order), written with each row's place; the places where a group begins in
    each partition, a row a group and partition, turn these into numbers of the
    group. A group that holds most rows is spread like any other. ``order_by``
    must be unique within a group.
    """
    keys = [*group, *order_by]
    spread = settle(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "number_within")
    spread = spread.withColumn("_part", F.shiftright("_at", 33))
    spans = spread.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = settle(spans.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_rows"), "number_spans")
    out = spread.alias("t").join(broadcast_if_bounded(spans).alias("s"), [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*group, "_part"]])
    return out.select(*[F.col(f"t.{c}") for c in df.columns], (F.lit(start) + F.col("_at") - F.col("_first") + F.col("_before")).cast("bigint").alias(name))


def apply_changes(
    target: DataFrame,
    events: DataFrame,
    key: list[str],
    keep_markers: bool = False,
    strict: bool = False,
) -> DataFrame:
    """DER-1: replay a change log onto a table (batch form of the stream apply).

    The log is first reduced to the last event of each key (partial
    aggregation, so hot keys shrink before the shuffle), then joined once with
    the target: ``r``/``c``/``u`` install the event's ``after`` row, ``d``
    removes the key, keys without events keep their row. The events must be of
    one table; they are grouped by the flat key columns, whose exchange the join
    reuses.

    When the target carries ``_seq`` (position of the last applied event per
    key) an event applies only if its ``seq`` is newer, which makes a replayed
    batch a no-op. With ``keep_markers`` deleted keys stay as ``_deleted`` rows
    so a late, older update cannot bring them back. Repeated deliveries of one
    event are harmless; different events at a key's last ``seq`` fail the job.
    ``strict`` first rejects a log with any equal ``seq`` of one key
    (``require_ordered``).
    """
    if strict:
        require_ordered(events)
    cols = [c for c in target.columns if c not in ("_seq", "_deleted")]
    tracked = "_seq" in target.columns
    flat = events.select(F.struct(*[F.col(f"key.{k}").alias(k) for k in key]).alias("key"), F.lit(0).alias("table"), "op",
                         F.col("after").alias("before"), "after", "commit_ts", "seq")
    net = last_events(flat, by=key).select(
        *key,
        F.col("op").alias("_op"),
        F.col("seq").alias("_ev_seq"),
        *[F.col(f"after.{c}").alias(f"_a_{c}") for c in cols if c not in key],
    )
    # An untracked target joins as it is (its exchange can be shared with other
    # joins over the same table); the marker columns are added after the join.
    t_seq = _c("t", "_seq") if tracked else F.lit(None).cast("bigint")
    t_del = _c("t", "_deleted") if "_deleted" in target.columns else F.lit(False)
    t = _tag(target, "t")
    n = _tag(net, "n")
    j = t.join(n, [_c("t", k) == _c("n", k) for k in key], "full_outer")
    in_t, in_n = _present("t"), _present("n")
    use_event = in_n & (~in_t | t_seq.isNull() | (_c("n", "_ev_seq") > t_seq))
    deleted = F.when(use_event, _c("n", "_op") == "d").otherwise(F.coalesce(t_del, F.lit(False)))
    exprs = []
    for c in cols:
        if c in key:
            exprs.append(F.coalesce(_c("t", c), _c("n", c)).alias(c))
        else:
            exprs.append(F.when(use_event, _c("n", f"_a_{c}")).otherwise(_c("t", c)).alias(c))
    seq = F.when(use_event, _c("n", "_ev_seq")).otherwise(t_seq).alias("_seq")
    out = j.select(*exprs, seq, deleted.alias("_deleted"))
    if keep_markers:
        return out
    out = out.filter(~F.col("_deleted")).drop("_deleted")
    return out if tracked else out.drop("_seq")

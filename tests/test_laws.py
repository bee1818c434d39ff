"""Algebraic laws of capture, net changes, replay and the upsert family."""

from pyspark.sql import functions as F

from changeflow import operators as op
from changeflow.plans import versions as V
from conftest import SF_SMALL, rows

KEY = ["k"]


def _vs(spark):
    return V.versions(spark, SF_SMALL)


def test_capture_counts_match_the_version_rules(spark):
    a, b, _ = _vs(spark)
    ev = op.capture(a, b, V.TABLE, KEY, 1)
    counts = dict(ev.groupBy("op").count().collect())
    n = a.count()
    tenth = a.filter(F.col("k") % 10 == 0).count()
    assert counts["d"] == tenth
    assert counts["c"] == a.filter(F.col("k") % 10 == 3).count()
    assert counts["u"] == a.filter((F.col("k") % 10).isin(1, 2)).count()
    assert sum(counts.values()) < n


def test_replay_of_capture_gives_the_new_version(spark):
    a, b, c = _vs(spark)
    assert rows(op.apply_changes(a, op.capture(a, b, V.TABLE, KEY, 1), KEY)) == rows(b)
    log = op.capture(a, b, V.TABLE, KEY, 1).unionByName(op.capture(b, c, V.TABLE, KEY, 2))
    assert rows(op.apply_changes(a, log, KEY)) == rows(c)


def test_replay_twice_equals_replay_once(spark):
    a, _, c = _vs(spark)
    log = V.change_log(spark, SF_SMALL)
    once = op.apply_changes(a, log, KEY)
    # Idempotence with position tracking: the target remembers _seq per key.
    tracked = op.apply_changes(a.withColumn("_seq", F.lit(None).cast("bigint")), log, KEY)
    again = op.apply_changes(tracked, log, KEY).drop("_seq")
    assert rows(once) == rows(c) == rows(again)


def test_net_changes_replay_equals_full_replay(spark):
    a, _, _ = _vs(spark)
    log = V.change_log(spark, SF_SMALL)
    assert rows(op.apply_changes(a, op.net_changes(log), KEY)) == rows(op.apply_changes(a, log, KEY))


def test_net_of_two_captures_agrees_with_direct_capture(spark):
    a, _, c = _vs(spark)
    log = V.change_log(spark, SF_SMALL)
    net = op.net_changes(log, drop_noop=True)
    direct = op.capture(a, c, V.TABLE, KEY, 9)

    def keys(df, o):
        return sorted(r[0] for r in df.filter(F.col("op") == o).select("key.k").collect())

    for o in ("c", "d", "u"):
        assert keys(net, o) == keys(direct, o), o
    # Without drop_noop the reverted rows stay as u.
    assert op.net_changes(log).filter(F.col("op") == "u").count() > net.filter(F.col("op") == "u").count()


def test_shuffled_log_gives_the_same_result(spark):
    a, _, c = _vs(spark)
    log = V.change_log(spark, SF_SMALL).repartition(7).orderBy(F.rand(3))
    assert rows(op.apply_changes(a, log, KEY)) == rows(c)


def test_upsert_is_idempotent(spark):
    a, b, _ = _vs(spark)
    src = b.filter((F.col("k") % 10).isin(1, 2) | (F.col("k") < 0)).select("k", "status", "total")
    once = op.upsert(a, src, KEY, ["status"], defaults={"order_date": F.lit(None)})
    twice = op.upsert(once, src, KEY, ["status"], defaults={"order_date": F.lit(None)})
    assert rows(once) == rows(twice)


def test_insert_if_absent_never_updates(spark):
    a, b, _ = _vs(spark)
    out = op.insert_if_absent(a, b, KEY)
    joined = out.join(a.withColumnRenamed("status", "s0"), "k").filter(~F.col("status").eqNullSafe(F.col("s0")))
    assert joined.count() == 0
    assert out.count() == a.count() + b.join(a, "k", "left_anti").count()


def test_unnest_of_nest_is_identity(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    docs = op.nest(li, ["l_orderkey"], ["l_linenumber", "l_partkey"])
    assert rows(op.unnest(docs, ["l_orderkey"])) == rows(li)


def test_nest_splits_hot_keys_into_bounded_chunks(spark):
    df = spark.range(0, 5000).select(F.lit(1).alias("key"), F.col("id").alias("v"))
    docs = op.nest(df, ["key"], ["v"], max_items=1000)
    sizes = [r[0] for r in docs.select(F.size("items")).collect()]
    assert len(sizes) == 5 and sum(sizes) == 5000 and max(sizes) < 1500
    assert rows(op.unnest(docs, ["key"])) == rows(df)


def test_tombstones_off_is_identity(spark):
    log = V.change_log(spark, SF_SMALL)
    off = op.tombstones(log, on=False)
    assert rows(off.drop("is_tombstone"), "key", "op", "seq") == rows(log, "key", "op", "seq")
    on = op.tombstones(log, on=True)
    assert on.count() == log.count() + log.filter(F.col("op") == "d").count()


def test_log_delivered_twice_replays_like_once(spark):
    a, _, c = _vs(spark)
    log = V.change_log(spark, SF_SMALL)
    assert rows(op.apply_changes(a, log.unionByName(log), KEY)) == rows(c)
    assert rows(op.net_changes(log.unionByName(log)), "key", "op", "seq") == rows(op.net_changes(log), "key", "op", "seq")

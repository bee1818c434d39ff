"""What is maintained from changes: windowed snapshots, digests, folded aggregates, cascades, lists with validity."""

import random

import pytest
from pyspark.sql import functions as F

from changeflow import operators as op
from changeflow.operators.cascade import CASCADE, RESTRICT, Reference, parents_first
from changeflow.operators.digests import rows_of
from changeflow.plans import versions as V
from changeflow.plans.registry import QUERIES
from conftest import SF_SMALL, rows

# --------------------------------------------------------------------------- CAP-13

STATE = "k long, v string"


def _history(n_keys, n_events, seed):
    """(states by position, events): a table's rows after every position, and its log."""
    rng = random.Random(seed)
    state = {k: "s" for k in range(n_keys) if rng.random() < 0.8}
    states, events = [dict(state)], []
    for seq in range(1, n_events + 1):
        k = rng.randrange(n_keys)
        old = state.get(k)
        if old is None:
            o, new = "c", f"c{seq}"
        elif rng.random() < 0.3:
            o, new = "d", None
        else:
            o, new = "u", f"u{seq}"
        state.pop(k, None)
        if new is not None:
            state[k] = new
        events.append(("public.orders", o, (k,), None if old is None else (k, old), None if new is None else (k, new), None, seq))
        states.append(dict(state))
    return states, events


EVENT = "table string, op string, key struct<k:long>, before struct<k:long,v:string>, after struct<k:long,v:string>, commit_ts timestamp, seq long"
WINDOW = "signal_id string, table string, chunk long, low long, high long"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_chunk_with_its_window_replays_to_the_last_state(spark, seed):
    states, events = _history(60, 150, seed)
    rng = random.Random(seed)
    log = spark.createDataFrame(events, EVENT)
    requests = spark.createDataFrame([("public.orders", "s1", "incremental")], "table string, signal_id string, snapshot_type string")
    windows, read = [], []
    for chunk in range(6):
        low = rng.randrange(0, 120)
        high = low + rng.randrange(1, 30)
        at = rng.randint(low, high)
        windows += [("s1", "public.orders", chunk, low, high), ("unsent", "public.orders", chunk, 0, 150), ("s1", "public.users", chunk, 0, 1)]
        read += [(k, v) for k, v in states[at].items() if k // 10 == chunk]
    snap = op.windowed_snapshot(spark.createDataFrame(read, STATE), "public.orders", ["k"], 10, requests, spark.createDataFrame(windows, WINDOW), log)
    want = {c: (lo, hi) for s, t, c, lo, hi in windows if s == "s1" and t == "public.orders"}
    moved = {(e[2][0], e[6]) for e in events}
    kept = {k for k, _ in read if not any(key == k and want[k // 10][0] < seq <= want[k // 10][1] for key, seq in moved)}
    got = snap.collect()
    assert {r.key.k for r in got} == kept and all(r.seq == want[r.chunk][1] and r.signal_id == "s1" for r in got)
    # A chunk is read as of its window, so the log before it is in its rows; the rest is replayed.
    every = snap.select(*log.columns).unionByName(log)
    state = op.apply_changes(spark.createDataFrame([], STATE), every, ["k"])
    assert rows(state) == sorted(states[-1].items())


def test_events_outside_their_chunks_window_remove_nothing(spark):
    log = spark.createDataFrame([("public.orders", "u", (k,), (k, "a"), (k, "b"), None, 7) for k in (5, 15)], EVENT)
    windows = spark.createDataFrame([("s", "public.orders", 0, 3, 6), ("s", "public.orders", 1, 6, 9)], WINDOW)
    requests = spark.createDataFrame([("public.orders", "s", "x"), ("public.orders", "s", "x")], "table string, signal_id string, snapshot_type string")
    df = spark.createDataFrame([(5, "a"), (6, "a"), (15, "a"), (16, "a"), (25, "a")], STATE)
    got = {r.key.k: r.seq for r in op.windowed_snapshot(df, "public.orders", ["k"], 10, requests, windows, log).collect()}
    assert got == {5: 6, 6: 6, 16: 9}
    assert op.windowed_snapshot(df, "public.orders", ["k"], 10, requests.limit(0), windows, log).count() == 0


# --------------------------------------------------------------------------- CAP-2 by digests


def test_digests_find_the_same_changes_and_join_few_rows(spark):
    old = spark.range(100_000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("a"), F.lit(None).cast("string").alias("b"))
    hit = (F.col("k") / 1000).cast("long") == 42
    new = old.filter(~hit | (F.col("k") % 3 != 0)).withColumn("b", F.when(hit & (F.col("k") % 3 == 1), F.col("a"))).withColumn("a", F.when(~(hit & (F.col("k") % 3 == 1)), F.col("a")))
    want = op.capture(old, new, "t", ["k"], 1)
    got = op.capture_by_digest(old, new, "t", ["k"], 1, 1000)
    assert rows(got, "op", "key", "seq") == rows(want, "op", "key", "seq") and want.count() > 500
    digests = [op.range_digests(df, ["k"], 1000) for df in (old, new)]
    changed = op.changed_ranges(*digests, fanout=8)
    assert [r.range for r in changed.collect()] == [42]
    joined = sum(rows_of(df, ["k"], 1000, changed).count() for df in (old, new))
    assert joined < 0.05 * (old.count() + new.count())
    assert rows(op.capture_by_digest(old, new, "t", ["k"], 1, 1000, old_digests=digests[0], new_digests=digests[1]), "op", "key") == rows(want, "op", "key")


def test_digests_of_composite_keys_maps_and_empty_versions(spark):
    old = spark.createDataFrame([(i, str(i % 3), {"x": i}) for i in range(50)], "a long, b string, m map<string,long>")
    new = old.filter("a <> 4").withColumn("m", F.when(F.col("a") == 9, F.create_map(F.lit("x"), F.lit(-1).cast("long"))).otherwise(F.col("m")))
    values = lambda df: df.select("a", "b", F.to_json("m").alias("m"))
    for x, y in ((old, new), (old.limit(0), old), (old, old.limit(0)), (old, old)):
        got = op.capture_by_digest(values(x), values(y), "t", ["a", "b"], 1, 10)
        assert rows(got, "op", "key") == rows(op.capture(values(x), values(y), "t", ["a", "b"], 1), "op", "key")
    assert op.changed_ranges(op.range_digests(old, ["a", "b"], 1), op.range_digests(new, ["a", "b"], 1)).count() in (1, 2)
    swapped = [spark.createDataFrame([(1, x, y)], "k long, a string, b string") for x, y in ((None, "v"), ("v", None))]
    assert op.capture_by_digest(*swapped, "t", ["k"], 1, 10).count() == 1


# --------------------------------------------------------------------------- folded aggregates


def test_folded_counts_equal_a_recount_after_any_cut(spark):
    states, events = _history(40, 120, 9)
    log = spark.createDataFrame(events, EVENT)
    by, sums = ["v"], {"keys": lambda r: r["k"]}
    table = lambda at: spark.createDataFrame(sorted(states[at].items()), STATE)
    for cut in (0, 37, 120):
        stored = op.aggregate_rows(table(cut), by, sums)
        got = op.fold_changes(stored, log.unionByName(log.filter("seq % 2 = 0")), by, sums, cut)
        assert rows(got, "v", "n", "keys") == rows(op.aggregate_rows(table(120), by, sums), "v", "n", "keys")
    again = op.fold_changes(op.aggregate_rows(table(120), by, sums), log, by, sums, 120)
    assert rows(again) == rows(op.aggregate_rows(table(120), by, sums))


def test_fold_rejects_a_log_that_does_not_follow(spark):
    log = spark.createDataFrame([("t", "d", (1,), (1, "x"), None, None, 1)], EVENT)
    with pytest.raises(Exception, match="more rows of a group"):
        op.fold_changes(op.aggregate_rows(spark.createDataFrame([(1, "y")], STATE), ["v"]), log, ["v"]).collect()
    twice = log.unionByName(spark.createDataFrame([("t", "d", (1,), (1, "y"), None, None, 1)], EVENT))
    with pytest.raises(Exception, match="equal seq"):
        op.fold_changes(op.aggregate_rows(spark.createDataFrame([(1, "x"), (1, "y")], STATE), ["v"]), twice, ["v"]).collect()


# --------------------------------------------------------------------------- cascades


def _family(spark):
    tables = {
        "users": spark.createDataFrame([(i, None if i < 3 else i // 3) for i in range(1, 20)], "id long, boss long"),
        "orders": spark.createDataFrame([(i, i % 19 + 1 if i % 5 else None) for i in range(40)], "id long, user_id long"),
        "items": spark.createDataFrame([(i // 3, i % 3, i % 7) for i in range(120)], "order_id long, line long, product_id long"),
        "products": spark.createDataFrame([(i,) for i in range(9)], "id long"),
    }
    keys = {"users": ["id"], "orders": ["id"], "items": ["order_id", "line"], "products": ["id"]}
    references = [Reference("items", ["order_id"], "orders", CASCADE), Reference("orders", ["user_id"], "users", CASCADE),
                  Reference("items", ["product_id"], "products", RESTRICT), Reference("users", ["boss"], "users", CASCADE)]
    return tables, keys, references


def test_cascade_follows_all_levels_and_a_table_that_refers_to_itself(spark):
    tables, keys, references = _family(spark)
    left = op.delete_cascading(tables, keys, references, {"users": spark.createDataFrame([(2,)], "id long"), "orders": spark.createDataFrame([(0,)], "id long")})
    gone = {2}
    while more := {r.id for r in tables["users"].collect() if r.boss in gone} - gone:
        gone |= more
    orders = {r.id for r in tables["orders"].collect() if r.user_id in gone} | {0}
    assert len(gone) > 4 and rows(left["users"], "id") == sorted((i,) for i in range(1, 20) if i not in gone)
    assert rows(left["orders"], "id") == sorted((i,) for i in range(40) if i not in orders)
    assert rows(left["items"], "order_id", "line") == sorted((i // 3, i % 3) for i in range(120) if i // 3 not in orders)
    assert left["products"].count() == 9


def test_restrict_holds_rows_unless_the_child_goes_too(spark):
    tables, keys, references = _family(spark)
    product = spark.createDataFrame([(3,)], "id long")
    with pytest.raises(Exception, match="items still refers to a deleted row of products"):
        op.delete_cascading(tables, keys, references, {"products": product})["items"].collect()
    users = tables["items"].filter("product_id = 3").select(F.col("order_id").alias("id"))
    left = op.delete_cascading(tables, keys, references, {"products": product, "orders": users})
    assert left["items"].filter("product_id = 3").count() == 0 and left["products"].count() == 8
    unused = op.delete_cascading(tables, keys, references, {"products": spark.createDataFrame([(8,)], "id long")})
    assert unused["items"].count() == 120


def test_cycles_of_tables_are_refused():
    ring = [Reference("a", ["x"], "b", CASCADE), Reference("b", ["y"], "a", CASCADE)]
    with pytest.raises(ValueError, match="cycle"):
        parents_first(["a", "b"], ring)
    assert parents_first(["c", "b", "a"], [Reference("c", ["x"], "b", CASCADE), Reference("b", ["x"], "a", RESTRICT), Reference("a", ["x"], "a", CASCADE)]) == ["a", "b", "c"]


# --------------------------------------------------------------------------- capture lists with validity


def test_each_event_is_judged_by_the_list_of_its_position(spark):
    names = lambda *t: spark.createDataFrame([(x,) for x in t], "table string")
    lists = op.replace_capture_list(None, names("a", "b", "a"), 3)
    lists = op.replace_capture_list(lists, names(), 6)
    lists = op.replace_capture_list(lists, names("b", "c"), 8)
    events = spark.createDataFrame([(t, s) for t in "abcd" for s in range(1, 11)], "table string, seq long")
    at = lambda s: set() if s < 3 else {"a", "b"} if s < 6 else set() if s < 8 else {"b", "c"}
    assert rows(op.capture_list_asof(events, lists)) == sorted((t, s) for t in "abcd" for s in range(1, 11) if t in at(s))


# --------------------------------------------------------------------------- source keys


def test_two_source_documents_of_one_key_fail(spark):
    docs = spark.createDataFrame([(1, "a")], "_id long, name string")
    src = spark.createDataFrame([(2, "x"), (2, "y"), (1, "z"), (1, "z")], "_id long, name string")
    with pytest.raises(Exception, match="duplicate source key"):
        op.doc_upsert(docs, src, ["_id"], ["name"]).collect()


def test_null_match_value_fails_and_takes_no_id(spark):
    target = spark.createDataFrame([(5, "a")], "id long, name string")
    src = spark.createDataFrame([(None, 1), ("b", 2), (None, 3)], "name string, n long")
    with pytest.raises(Exception, match="NULL match value"):
        op.find_or_create(target, src, ["name"], "id")
    resolved, table = op.find_or_create(target, src.filter("name is not null"), ["name"], "id")
    assert rows(resolved, "name", "id") == [("b", 6)] and rows(table, "id", "name") == [(5, "a"), (6, "b")]


@pytest.mark.parametrize("name", ["key_gaps", "absent_keys", "written_tables", "loaded_together", "check_foreign_key", "include_databases", "parse_tags", "nested_arrays",
                                  "signal_windows", "capture_digests", "maintained_counts", "maintained_order_totals", "cascade_graph", "capture_list_versions"])
def test_rows_that_can_fail(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_versions_differ_in_few_ranges(spark):
    ev = QUERIES["capture_digests"](spark, SF_SMALL)
    assert {r.op for r in ev.select("op").distinct().collect()} == {"c", "u", "d"} and ev.count() < 0.1 * V.v1(spark, SF_SMALL).count()


# --------------------------------------------------------------------------- several intervals at once


@pytest.mark.parametrize("seed", [4, 5])
def test_intervals_equal_their_own_runs(spark, seed):
    _, events = _history(30, 100, seed)
    log = spark.createDataFrame(events, EVENT)
    log = log.unionByName(log.filter("seq % 3 = 0"))
    cuts = [(0, 100), (10, 40), (35, 80), (40, 41), (90, 95)]
    got = op.net_changes_intervals(log, cuts)
    for lo, hi in cuts:
        own = got.filter((F.col("low") == lo) & (F.col("high") == hi)).drop("low", "high")
        assert rows(own, "op", "key", "seq") == rows(op.net_changes(log.filter((F.col("seq") > lo) & (F.col("seq") <= hi))), "op", "key", "seq")
        assert sorted(map(repr, own.collect())) == sorted(map(repr, op.net_changes(log.filter((F.col("seq") > lo) & (F.col("seq") <= hi))).collect()))
    clash = log.unionByName(log.filter("seq = 20").withColumn("op", F.lit("x")))
    with pytest.raises(Exception, match="equal seq"):
        op.net_changes_intervals(clash, [(19, 20), (0, 5)]).collect()


# --------------------------------------------------------------------------- keyed partitions


def _murmur2(data):
    m, h = 0x5BD1E995, 0x9747B28C ^ len(data)
    cut = len(data) // 4 * 4
    for i in range(0, cut, 4):
        k = int.from_bytes(data[i : i + 4], "little") * m & 0xFFFFFFFF
        k = (k ^ k >> 24) * m & 0xFFFFFFFF
        h = (h * m & 0xFFFFFFFF) ^ k
    if data[cut:]:
        h = (h ^ int.from_bytes(data[cut:], "little")) * m & 0xFFFFFFFF
    h = (h ^ h >> 13) * m & 0xFFFFFFFF
    return h ^ h >> 15


def test_murmur2(spark):
    from changeflow.functions.partitioner import murmur2, partition_of

    texts = ["", "a", "ab", "abc", "abcd", "21", "foobar", "a-little-bit-long-string", "a-little-bit-longer-string", "lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8", "é日本", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", murmur2(F.col("t")).alias("h"), partition_of(F.col("t"), 7).alias("p")).collect()
    assert [r.h for r in got] == [None if t is None else _murmur2(t.encode()) for t in texts]
    # Published values of the hash, as signed 32-bit numbers.
    known = {"21": -973932308, "foobar": -790332482, "a-little-bit-long-string": -985981536, "abc": 479470107}
    assert {r.t: r.h - (1 << 32 if r.h >= 1 << 31 else 0) for r in got if r.t in known} == known
    assert all(r.p == (_murmur2(r.t.encode()) & 0x7FFFFFFF) % 7 for r in got if r.t is not None)


def test_numbers_within_groups_are_dense_and_in_order_after_a_write(spark, scratch):
    rng = random.Random(2)
    data = [("hot" if i % 3 else f"g{i % 7}", i, rng.random()) for i in range(3000)] + [(None, 5000, 0.0)]
    op.number_within(spark.createDataFrame(data, "g string, seq long, x double").repartition(9), ["g"], ["seq"], "n", 1).write.parquet(f"{scratch}/out")
    got = {}
    for r in spark.read.parquet(f"{scratch}/out").orderBy("seq").collect():
        got.setdefault(r.g, []).append(r.n)
    assert sum(map(len, got.values())) == 3001 and all(v == list(range(1, len(v) + 1)) for v in got.values())


# --------------------------------------------------------------------------- references of a batch


def test_batch_orphans_are_exact_and_few_parents_reach_the_join(spark):
    parent = spark.range(0, 200_000, 2).select(F.col("id").alias("pid"), F.lit("x").alias("payload"))
    batch = spark.createDataFrame([(i, None if i % 50 == 0 else i * 97 % 250_000) for i in range(2000)], "id long, ref long")
    got = op.foreign_key_batch(batch, parent, [("ref", "pid")])
    assert rows(got) == rows(op.foreign_key(batch, parent, [("ref", "pid")])) and got.count() > 500
    kept = op.referenced(parent, batch, [("ref", "pid")])
    wrong = kept.join(batch.select("ref"), "ref", "left_anti").count()
    assert kept.join(batch.select("ref").distinct(), "ref", "left_semi").count() + wrong == kept.count() and wrong < 0.05 * parent.count()
    assert op.foreign_key_batch(batch.limit(0), parent, [("ref", "pid")]).count() == 0
    assert op.foreign_key_batch(batch, parent.limit(0), [("ref", "pid")]).count() == batch.filter("ref is not null").count()


# --------------------------------------------------------------------------- streams


def test_ranges_merge_and_tell_what_is_new():
    import numpy as np

    from changeflow.streaming.ranges import merge_ranges, unseen

    rng = random.Random(7)
    starts, ends, seen = np.empty(0, np.int64), np.empty(0, np.int64), set()
    for _ in range(60):
        numbers = np.array([rng.randrange(300) for _ in range(rng.randrange(1, 25))])
        fresh = unseen(starts, ends, numbers)
        want, mine = [], set(seen)
        for x in numbers.tolist():
            want.append(x not in mine)
            mine.add(x)
        assert fresh.tolist() == want
        starts, ends = merge_ranges(starts, ends, numbers[fresh])
        seen = mine
        assert {x for a, b in zip(starts, ends) for x in range(a, b + 1)} == seen and (starts[1:] > ends[:-1] + 1).all()


def test_late_first_deliveries_come_out_once_and_state_is_ranges(spark, scratch):
    from changeflow.streaming.ranges import dedup_numbered

    schema = "shard long, number long, v string"
    rng = random.Random(3)
    every = [(s, n, f"{s}-{n}") for s in range(4) for n in range(200)]
    late = [r for r in every if r[1] in (17, 18, 150)]
    batches = [[r for r in every if r[1] < 120 and r not in late], [r for r in every if r[1] >= 60 and r not in late] + rng.sample(every[:50], 0), late + rng.sample(every, 300)]
    progress = None
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        q = dedup_numbered(spark.readStream.schema(schema).parquet(f"{scratch}/in"), "shard", "number").writeStream.option(
            "checkpointLocation", f"{scratch}/c").trigger(availableNow=True).start(f"{scratch}/out")
        q.awaitTermination()
        progress = [p for p in q.recentProgress if p["stateOperators"]][-1] if i == 2 else progress
    got = rows(spark.read.parquet(f"{scratch}/out"), "shard", "number", "v")
    assert got == sorted(every)
    # One state row a shard, whatever the number of events.
    assert progress["stateOperators"][0]["numRowsTotal"] == 4


def test_a_dropped_position_starts_from_the_snapshot(spark):
    out = QUERIES["stream_position_dropped"](spark, SF_SMALL)
    assert out.count() == out.distinct().count()
    for start, first in ((1, V.v1(spark, SF_SMALL)), (2, V.v2_from(V.v1(spark, SF_SMALL)))):
        assert out.filter((F.col("start") == start) & (F.col("op") == "r")).count() == first.count()

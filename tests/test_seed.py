"""Seed generators: ranges, label shares, reproducibility."""

from pyspark.sql import functions as F

from changeflow.operators import seed
from changeflow.sources import series


def test_value_ranges(spark):
    ids = series(spark, 1, 20000)
    p = seed.seed_products(ids).agg(F.min("price"), F.max("price"), F.min("stock_quantity"),
                                    F.max("stock_quantity"), F.min("category_id"), F.max("category_id")).first()
    assert float(p[0]) >= 10 and float(p[1]) <= 100 and p[2] == 0 and p[3] == 100 and p[4] == 1 and p[5] == 10
    lg = seed.seed_inventory_logs(ids).agg(F.min("change_quantity"), F.max("change_quantity")).first()
    assert (lg[0], lg[1]) == (-10, 10)


def test_payment_shares(spark):
    pay = seed.seed_payments(series(spark, 1, 100000))
    shares = {r[0]: r[1] / 100000 for r in pay.groupBy("payment_method").count().collect()}
    assert abs(shares["credit_card"] - 0.25) < 0.02 and abs(shares["paypal"] - 0.75) < 0.02
    st = {r[0]: r[1] / 100000 for r in pay.groupBy("status").count().collect()}
    assert abs(st["completed"] - 0.25) < 0.02


def test_order_status_thirds(spark):
    o = seed.seed_orders(series(spark, 1, 90000))
    for _, n in o.groupBy("status").count().collect():
        assert abs(n / 90000 - 1 / 3) < 0.02


def test_partitioning_does_not_change_values(spark):
    a = seed.seed_order_items(series(spark, 1, 5000))
    b = seed.seed_order_items(series(spark, 1, 5000).repartition(13))
    assert sorted(a.collect()) == sorted(b.collect())


def test_users_times(spark):
    u = seed.seed_users(series(spark, 1, 3)).orderBy("user_id").collect()
    assert u[0]["username"] == "user_1" and u[0]["email"] == "user_1@example.com"
    assert str(u[2]["created_at"]) == "2025-12-31 23:57:00"
    c = seed.seed_categories(series(spark, 1, 10)).orderBy("category_id").collect()
    assert c[9]["name"] == "Category 10"


def test_populate_publishes_all_tables_and_is_idempotent(spark, scratch):
    from changeflow.plans.populate import populate, seed_frames
    from changeflow.sinks import committed_versions, read_current

    root = f"{scratch}/db"
    frames = seed_frames(spark)
    populate(spark, root, frames, version=1)
    counts = {t: read_current(spark, root, t).count() for t in frames}
    assert sum(counts.values()) == 10 + 6 * 1000
    first = {t: sorted(read_current(spark, root, t).collect()) for t in frames}
    populate(spark, root, seed_frames(spark), as_of="2026-03-01 00:00:00", version=2)
    assert committed_versions(spark, root) == [1, 2]
    for t in frames:
        again = read_current(spark, root, t)
        if t == "products":
            again = again.drop("updated_at")
            assert sorted(again.collect()) == sorted(r[:-1] for r in first[t])
            assert {str(r[0]) for r in read_current(spark, root, t).select("updated_at").distinct().collect()} == {
                "2026-03-01 00:00:00"}
        else:
            assert sorted(again.collect()) == first[t], t


def test_seeded_model_foreign_keys(spark):
    from changeflow import operators as op
    from changeflow.plans.populate import seed_frames
    from changeflow.schemas import RELATIONAL_FKS

    frames = seed_frames(spark)
    assert op.foreign_keys(frames, RELATIONAL_FKS).count() == 0
    frames["orders"] = frames["orders"].filter(F.col("order_id") != 7)
    orphans = op.foreign_keys(frames, RELATIONAL_FKS)
    by_fk = {r["fk"] for r in orphans.collect()}
    assert set(by_fk) <= {"order_items.order_id->orders", "payments.order_id->orders"}
    assert orphans.filter(F.col("fk") == "payments.order_id->orders").select("ref").collect()[0][0] == "7"

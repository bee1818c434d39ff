"""Queries over every order, on tables where a part of the orders gives other rows."""

import duckdb
import pytest
from conftest import rows

from __spark_entry__ import oracle_sql
from changeflow.plans.registry import QUERIES


@pytest.fixture()
def shop(spark, scratch):
    orders = [(1, 10, "F"), (2, 20, "O"), (4, 10, "F"), (4, 10, "F"), (7, 20, "P"), (9, None, None), (None, 30, "O")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{scratch}/orders.parquet")
    spark.createDataFrame([(k, f"c{k}") for k in (10, 20, 30, 40)], "c_custkey long, c_name string").write.parquet(f"{scratch}/customer.parquet")
    return scratch


def _same_as_sql(name, shop, got):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{shop}/{t}.parquet/*.parquet')")
    res = con.execute(oracle_sql()[name])
    assert [d[0] for d in res.description] == got.columns
    assert sorted(res.fetchall(), key=repr) == sorted(map(tuple, got.collect()), key=repr)


def test_key_gaps_of_all_orders(spark, shop):
    got = QUERIES["key_gaps"](spark, shop)
    assert rows(got.filter("o_orderstatus IS NULL"), "o_orderkey") == [(3,), (5,), (6,), (8,)]
    assert rows(got.filter("o_orderstatus IS NOT NULL"), "o_orderstatus", "o_orderkey") == [("F", 2), ("F", 3)]
    _same_as_sql("key_gaps", shop, got)


def test_key_gaps_of_no_orders(spark, scratch):
    spark.createDataFrame([], "o_orderkey long, o_orderstatus string").write.parquet(f"{scratch}/orders.parquet")
    assert QUERIES["key_gaps"](spark, scratch).collect() == []


def test_absent_keys_of_all_orders(spark, shop):
    got = QUERIES["absent_keys"](spark, shop)
    assert rows(got.filter("o_orderstatus IS NULL"), "c_custkey", "c_name") == [(40, "c40")]
    want = [(10, "O"), (10, "P"), (20, "F"), (30, "F"), (30, "P"), (40, "F"), (40, "O"), (40, "P")]
    assert rows(got.filter("o_orderstatus IS NOT NULL"), "c_custkey", "o_orderstatus") == want
    _same_as_sql("absent_keys", shop, got)

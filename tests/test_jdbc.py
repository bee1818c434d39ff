"""JDBC source in key ranges against an embedded in-memory Derby database (no server)."""

from changeflow.sources import scan_jdbc, write_jdbc

URL = "jdbc:derby:memory:changeflow;create=true"
PROPS = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_jdbc_roundtrip_in_ranges(spark):
    df = spark.range(1, 1001).selectExpr("cast(id as int) as product_id", "concat('Product ', id) as name")
    write_jdbc(df, URL, "products", mode="overwrite", properties=PROPS)
    back = scan_jdbc(spark, URL, "products", "product_id", 1, 1000, 4, properties=PROPS)
    assert back.rdd.getNumPartitions() == 4
    assert back.count() == 1000
    assert back.filter("product_id = 500").first()["name"] == "Product 500"


def test_jdbc_bounds_from_the_database(spark):
    from changeflow.sources import key_bounds, scan_jdbc_auto

    df = spark.range(10, 510).selectExpr("cast(id as int) as log_id", "cast(id % 21 - 10 as int) as change_quantity")
    write_jdbc(df, URL, "inventory_logs", mode="overwrite", properties=PROPS)
    assert key_bounds(spark, URL, "inventory_logs", "log_id", PROPS) == (10, 509)
    back = scan_jdbc_auto(spark, URL, "inventory_logs", "log_id", 3, properties=PROPS)
    assert back.rdd.getNumPartitions() == 3 and back.count() == 500


def test_string_keys_in_ranges(spark):
    from changeflow.sources.jdbc import scan_jdbc_strings, string_cuts

    df = spark.range(0, 300).selectExpr("concat('o''rder-', cast(id * 7919 % 300 as string)) as id", "cast(id as int) as quantity")
    write_jdbc(df, URL, "string_orders", mode="overwrite", properties=PROPS | {"createTableColumnTypes": "id VARCHAR(255)"})
    cuts = string_cuts(spark, URL, "string_orders", "id", 4, PROPS)
    back = scan_jdbc_strings(spark, URL, "string_orders", "id", cuts, PROPS)
    assert len(cuts) == 3 and back.rdd.getNumPartitions() == 4
    assert sorted(back.rdd.glom().map(len).collect()) == [75, 75, 75, 75]
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    assert scan_jdbc_strings(spark, URL, "string_orders", "id", [], PROPS).count() == 300

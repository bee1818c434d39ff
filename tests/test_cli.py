"""The command line lists, runs and explains registered queries."""

from changeflow.__main__ import main
from conftest import SF_SMALL


def test_cli_list_run_explain(spark, scratch, capsys):
    assert main(["list"]) == 0
    assert "capture_diff" in capsys.readouterr().out.split()
    assert main(["run", "check_unique", "--tables", SF_SMALL, "--local", "2", "--out", f"{scratch}/out"]) == 0
    assert spark.read.parquet(f"{scratch}/out").count() > 0
    assert main(["explain", "orders_by_status", "--tables", SF_SMALL, "--local", "2"]) == 0
    assert "PushedFilters" in capsys.readouterr().out
    assert main(["run", "no_such_query", "--tables", SF_SMALL]) == 2


def test_sql_views_over_tables_and_queries(spark):
    from changeflow.plans.views import register_views

    names = register_views(spark, SF_SMALL, prefix="cf_")
    assert "cf_orders" in names and "cf_net_changes" in names and "cf_stream_feed" not in names
    got = dict(spark.sql("SELECT op, count(*) AS n FROM cf_net_changes GROUP BY op").collect())
    assert set(got) == {"c", "u", "d"}
    assert spark.sql("SELECT count(*) FROM cf_capture_diff WHERE op = 'd'").first()[0] == \
        spark.sql("SELECT count(*) FROM cf_orders WHERE o_orderkey % 10 = 0").first()[0]

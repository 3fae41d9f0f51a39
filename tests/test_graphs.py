import duckdb

from orrery.plans import catalog


def test_module_graph_has_files_of_any_id(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 8), (100001, 9), (250000, 9)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 2), (2, 100001), (3, 250000), (4, 300000)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 2), (4, 2)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for t in ("supplier", "orders", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.queries()["module_graph_top20"](spark, str(tmp_path)).collect()]
    assert got == duck.execute(catalog.oracle_sql()["module_graph_top20"]).fetchall() == [("n7", "n9", 2), ("n7", "n8", 1), ("n8", "n9", 1)]

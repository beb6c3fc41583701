from tessella import session


def test_written_tables_can_be_read_again_and_cleared(spark):
    df = session.materialise(spark.range(3).withColumnRenamed("id", "a b"), "some")
    empty = session.materialise(spark.range(0), "none")
    assert df.count() == 3 and df.columns == ["a b"] and empty.count() == 0
    assert not df._jdf.queryExecution().toString().count("Range")
    assert session.clear(spark) and not session.clear(spark)


def test_workers_find_the_library(spark):
    session.ship(spark)
    assert spark.sparkContext.environment["PYTHONPATH"].split(":")[0] == session.ship(spark).sparkContext.environment["PYTHONPATH"].split(":")[0]


def test_tables_are_read_by_column(spark, sf_dir):
    plan = session.table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan

"""Table sinks and the durable (bucketed table) persistence mode."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgerlens.plans import product, revenue
from ledgerlens.plans.context import Marts
from ledgerlens.operators.quality import Rules
from ledgerlens.sources.sinks import materialize, publish_table, save_bucketed, save_table, table_name

SF = "/root/testdata/sf0.001"


def test_save_table_fails_if_exists(spark, tmp_path):
    df = spark.range(5)
    path = save_table(df, "t1", root=str(tmp_path))
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(AnalysisException):
        save_table(df, "t1", root=str(tmp_path))


def test_materialize_cuts_lineage(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    out = materialize(df, "m")
    assert sorted(r.x for r in out.collect()) == list(range(0, 20, 2))
    assert "Scan parquet" in out._jdf.queryExecution().executedPlan().toString() or \
        "FileScan parquet" in out._jdf.queryExecution().executedPlan().toString()


def test_bucketed_table_keeps_partitioning(spark, tmp_path):
    df = spark.range(1000).withColumn("k", F.col("id") % 37)
    t = save_bucketed(df, "b", "k", buckets=8, root=str(tmp_path))
    agg = t.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plan = agg._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert agg.count() == 37


def test_table_mode_matches_memory_mode(spark):
    mem = Marts.load(spark, SF, persist="memory")
    tab = Marts.load(spark, SF, persist="table")
    for build in (revenue.order_transactions, product.allocation, product.p_sales_h1):
        a = build(mem).exceptAll(build(tab)).count()
        b = build(tab).exceptAll(build(mem)).count()
        assert a == 0 and b == 0, build.__name__
    mem.release()


def test_source_view_names(spark):
    from ledgerlens.plans.views import SOURCE_NAMES, register_views
    m = Marts.load(spark, SF)
    names = register_views(m)
    assert len(names) == len(SOURCE_NAMES) == 33
    n = spark.sql("SELECT COUNT(*) AS n FROM Shipping_Report_H1").first()["n"]
    assert n == 6  # three shippers x two half-year periods
    assert spark.sql("SELECT SUM(Annual_Sales) AS s FROM Country_Transactions").first()["s"] == \
        spark.sql("SELECT SUM(Detailed_Net_Sales) AS s FROM Revnue_Transactions").first()["s"]


@pytest.fixture()
def growth_names(spark):
    from ledgerlens.plans.views import GROWTH_TABLES

    def drop():
        for t in GROWTH_TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {table_name(spark, t)}")

    drop()
    yield GROWTH_TABLES
    drop()


def test_save_growth_tables(spark, tmp_path, growth_names):
    from ledgerlens.plans.views import save_growth_tables
    m = Marts.load(spark, SF)
    folders = save_growth_tables(m, root=str(tmp_path))
    assert set(folders) == set(growth_names)
    back = spark.table(table_name(spark, "Country_Growth"))
    assert back.columns[:3] == ["Country", "Sales_96", "Profit_96"] and back.count() > 0
    assert dict(spark.table(table_name(spark, "Product_Growth")).dtypes)["Product_ID"] == "int"
    with pytest.raises(AnalysisException) as e:
        save_growth_tables(m, root=str(tmp_path))
    assert e.value.getCondition() == "TABLE_OR_VIEW_ALREADY_EXISTS"


GOOD = [(1, "Chai", "Tea"), (2, "Chang", "Tea")]
RULES = Rules(("id", "name"), ("id",), {"name": 5, "kind": 3})


@pytest.mark.parametrize("bad", [(None, "Chai", "Tea"), (3, None, "Tea"), (3_000_000_000, "Chai", "Tea"), (3, "Chaiii", "Tea"), (3, "Chai", "Teas")],
                         ids=["null id", "null name", "no int", "long name", "long kind"])
def test_a_violation_leaves_no_table(spark, tmp_path, bad):
    before = {t.name for t in spark.catalog.listTables()}
    df = spark.createDataFrame([*GOOD, bad], "id long, name string, kind string").repartition(3)
    with pytest.raises(Exception):
        publish_table(df, "ruled", RULES, root=str(tmp_path))
    assert {t.name for t in spark.catalog.listTables()} == before
    # The same rows without the bad one are published, once.
    publish_table(spark.createDataFrame([*GOOD, (3, None, None)], "id long, name string, kind string").where("name IS NOT NULL"), "ruled", RULES, root=str(tmp_path))
    try:
        assert sorted(spark.table("ruled").collect()) == GOOD
        ddl = spark.sql("SHOW CREATE TABLE ruled").first()[0]
        assert "id INT" in ddl and "name VARCHAR(5)" in ddl and "kind VARCHAR(3)" in ddl
        with pytest.raises(AnalysisException):
            publish_table(df, "ruled", RULES, root=str(tmp_path))
        assert sorted(spark.table("ruled").collect()) == GOOD
    finally:
        spark.sql("DROP TABLE ruled")


def test_bucket_count_is_within_spark_s_limit(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "745000")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "16")
    try:
        t = save_bucketed(spark.range(100).coalesce(1), "wide", "id", root=str(tmp_path))
        assert t.count() == 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")

"""What the plans of the marts look like: scans, aggregates, subqueries, pruning."""

from __future__ import annotations

import re

import pytest
from conftest import line, make_marts, order
from pyspark.sql import functions as F

from ledgerlens.plans import customer, employee, product, revenue, shipping
from ledgerlens.plans.context import Marts
from ledgerlens.plans.generic import stored_slices

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def m(spark):
    return Marts.load(spark, SF)


def line_scans(df) -> int:
    df.collect()
    return len(re.findall(r"FileScan parquet[^\n]*lineitem", final_plan(df)))


def final_plan(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "".join(part.split("== Initial Plan ==")[0] for part in [plan]) if "== Final Plan ==" in plan else plan


def test_nothing_is_cached(spark, m):
    for mart in (revenue.revenue_transactions, product.weighted_averages, product.p_sales_h2):
        mart(m).count()
    assert not spark.sparkContext._jsc.getPersistentRDDs()


@pytest.mark.parametrize("mart", [revenue.order_transactions, customer.customer_transactions, shipping.shipping_report])
def test_order_grain_sorts_no_lines(m, mart):
    assert "SortAggregate" not in mart(m)._jdf.queryExecution().executedPlan().toString()


def test_country_sales_read_no_line_joins(m):
    from ledgerlens.plans.country import country_transactions

    assert line_scans(country_transactions(m)) == 1


@pytest.mark.parametrize("mart", [product.allocation_summary, product.products_report, product.p_sales_h2, product.p_sales_h1])
def test_products_are_ids_while_grouped(m, mart):
    for keys in re.findall(r"Aggregate\(keys=\[([^\]]*)\]", mart(m)._jdf.queryExecution().executedPlan().toString()):
        assert "Product_Name" not in keys and "Category#" not in keys and "Year_ID" not in keys


@pytest.mark.parametrize("mart, most", [(product.category_performance, 1), (product.product_details, 2), (product.p_sales_h2, 2), (product.p_sales_h1, 2)])
def test_scans_of_the_lines(m, mart, most):
    assert line_scans(mart(m)) <= most


@pytest.mark.parametrize("mart", [revenue.order_transactions, revenue.monthly_transactions, employee.employee_transactions, product.product_details, product.allocation, product.p_sales_h1])
def test_customers_are_read_where_they_are_shown(m, mart):
    assert "customer.parquet" not in mart(m)._jdf.queryExecution().executedPlan().toString()


def test_period_totals_are_one_reused_subquery(m):
    df = product.product_details(m)
    df.collect()
    assert "ReusedSubquery" in final_plan(df)


def test_membership_is_an_existence_join(spark):
    # ReportsTo has a null, so ids that are not in it have an unknown answer.
    m = make_marts(spark, [order(1, emp=2), order(2, emp=4), order(3, emp=1), order(4, emp=77)], [line(i, 1, 1, "10") for i in (1, 2, 3, 4)])
    df = employee.employee_transactions(m)
    assert "ExistenceJoin" in df._jdf.queryExecution().executedPlan().toString()
    assert {r.Emp_ID: r.Position for r in df.collect()} == {1: "Manager", 2: "Supervisor", 4: "Employee", 77: "Manager"}


def test_stored_lines_prune_half_years(spark, m, tmp_path):
    folder = revenue.store_lines(m, f"{tmp_path}/lines")
    stored = Marts.load(spark, SF, line_store=folder)
    assert revenue.revenue_transactions(stored).exceptAll(revenue.revenue_transactions(m)).isEmpty()
    for mart in (product.discount_96, product.discount_97_h1, product.discount_97_h2, product.discount_98, product.p_sales_h1, product.p_sales_h2):
        df = mart(stored)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*_Half", plan), mart.__name__
        assert df.exceptAll(mart(m)).isEmpty() and mart(m).exceptAll(df).isEmpty(), mart.__name__


def test_slices_as_a_table_prune_at_run_time(m):
    df = stored_slices(m)
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 4


def test_returns_round_like_sales(spark):
    """Negative quantities and freight: halves away from zero on either side."""
    details = [line(1, 1, 1, "10"), line(1, 2, 1, "10"), line(2, 1, -1, "10"), line(2, 2, -1, "10"), line(3, 1, 1, "10"), line(3, 2, 1, "10")]
    m = make_marts(spark, [order(1, freight="0.05"), order(2, freight="0.05"), order(3, freight="-0.05")], details)
    got = {(r.Order_ID, r.Product_ID): float(r.Allocated_Freight) for r in product.allocation_fixed(m).collect()}
    assert got == {(1, 1): 0.03, (1, 2): 0.03, (2, 1): 0.03, (2, 2): 0.03, (3, 1): -0.03, (3, 2): -0.03}
    back = make_marts(spark, [order(1)], [line(1, 1, -3, "0.05", "0.1"), line(1, 2, 3, "0.05", "0.1")])
    assert sorted(float(r.Detailed_Net_Sales) for r in revenue.revenue_transactions(back).collect()) == [-0.14, 0.14]
    averages = {r.Product_ID: float(r.Product_Avg_Discount) for r in product.allocation_summary(back).collect()}
    assert averages == {1: -0.02, 2: 0.02}


def test_gross_is_price_times_quantity(spark):
    from decimal import Decimal as M

    m = make_marts(spark, [order(1)], [(1, 1, 3, M("3.3333"), M("0.05"), M("10.00"))])
    r = revenue.revenue_transactions(m).first()
    assert (float(r.Total_Sales), float(r.Detailed_Net_Sales)) == (9.9999, 9.50)


def test_ratio_with_a_scale(spark):
    from ledgerlens.functions import money

    df = spark.createDataFrame([("10", "3"), ("-10", "3"), ("1", "0"), ("0.00005", "1")], "a string, b string")
    cells = df.select(money.ratio(F.col("a").cast(money.MONEY), F.col("b").cast(money.MONEY), scale=4).alias("x")).collect()
    assert [None if r.x is None else float(r.x) for r in cells] == [3.3333, -3.3333, None, 0.0001]

"""Invariants that hold on any data (FIXTURES.md section 4), on sf0.01."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import customer, employee, growth, kpi, product, revenue
from ledgerlens.plans.context import Marts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def m(spark):
    marts = Marts.load(spark, SF)
    yield marts
    marts.release()


def test_fixed_shares_sum_to_one(m):
    s = product.weighted_averages_fixed(m).groupBy("Order_ID").agg(
        F.sum("WA_Q").alias("q"), F.sum("WA_Sales").alias("s"), F.sum("WA_Net_Sales").alias("n"))
    bad = s.where((F.abs(F.col("q") - 1) > 1e-9) | (F.abs(F.col("s") - 1) > 1e-9)
                  | (F.abs(F.col("n") - 1) > 1e-9)).count()
    assert bad == 0


def test_fixed_allocation_matches_order_freight(m):
    a = product.allocation_fixed(m).groupBy("Order_ID").agg(
        F.sum("Allocated_Freight").alias("alloc"), F.count(F.lit(1)).alias("n"))
    o = revenue.order_transactions(m).select(F.col("O_ID").alias("Order_ID"), "Freight")
    j = a.join(o, "Order_ID")
    bad = j.where(F.abs(F.col("alloc") - F.col("Freight")) > F.col("n") * 0.005).count()
    assert bad == 0


def test_faithful_allocation_is_partial(m):
    # The source's fan-out allocates only part of the freight.
    alloc = product.allocation(m).agg(F.sum("Allocated_Freight")).first()[0]
    total = revenue.order_transactions(m).agg(F.sum("Freight")).first()[0]
    assert 0 < alloc < total


def test_net_sales_agree_across_marts(m):
    lines = revenue.revenue_transactions(m).agg(F.sum("Detailed_Net_Sales")).first()[0]
    orders = revenue.order_transactions(m).agg(F.sum("O_Net_Sales")).first()[0]
    months = revenue.monthly_transactions(m).agg(F.sum("Monthly_Net_Sales")).first()[0]
    from ledgerlens.plans.country import country_transactions
    countries = country_transactions(m).agg(F.sum("Annual_Sales")).first()[0]
    products = product.product_transactions(m).agg(F.sum("P_Net_Sales")).first()[0]
    categories = product.category_performance(m).agg(F.sum("Category_N_Sales")).first()[0]
    customers = customer.customer_summary(m).agg(F.sum("Net_Purchases")).first()[0]
    employees = employee.employee_transactions(m).agg(F.sum("Net_Sales_Achieved")).first()[0]
    totals = kpi.sales_totals(m).first()["Net_Sales"]
    assert lines == orders == months == countries == products == categories == customers == employees == totals


def test_one_class_per_customer(m):
    cc = customer.customer_classification(m)
    assert cc.count() == cc.select("C_ID").distinct().count()


def test_aligned_growth_entities_subset(m):
    from ledgerlens.plans.country import country_transactions_h2
    g2 = {r[0] for r in growth.actual_country_growth(m).select("Country").collect()}
    h2 = {r[0] for r in country_transactions_h2(m).select("Country").collect()}
    assert g2 <= h2
    g4 = growth.actual_product_growth(m).select("Product_ID")
    h1 = product.p_sales_h1(m).where("per_Year = 1998").select("Product_ID")
    assert g4.subtract(h1).count() == 0


def test_delivered_plus_delayed(m):
    w = employee.employee_performance_wide(m)
    assert w.where(F.col("Delivered_Orders") + F.col("Delayed_Orders") != F.col("Orders_Made")).count() == 0


def test_growth_tables_keys_clean(m):
    from ledgerlens.plans.generic import enforce_not_null, enforce_type_len
    assert enforce_not_null(m).where("Null_Count > 0").count() == 0
    assert enforce_type_len(m).where("Violations > 0").count() == 0

"""Hand-made rows for each semantic quirk, expected values worked out by hand."""

from __future__ import annotations

from decimal import Decimal as M

import pytest
from pyspark.sql import functions as F

from conftest import D, line, make_marts, order, rows
from ledgerlens.plans import adhoc, customer, employee, growth, product, revenue, shipping
from ledgerlens.plans import country as country_plans


def test_m1_rounding_per_line(spark):
    m = make_marts(spark, [order(1)], [line(1, 1, 1, "1.15", "0.10"), line(1, 2, 1, "1.15", "0.10")])
    nets = rows(revenue.revenue_transactions(m), "Detailed_Net_Sales")
    assert sorted(n for (n,) in nets) == [M("1.0400"), M("1.0400")]
    total = revenue.order_transactions(m).collect()[0]["O_Net_Sales"]
    assert total == M("2.08")  # sum of rounded lines, not round(2.07)


def test_m2_null_ship_date_imputed(spark):
    m = make_marts(spark, [order(1, date=D(1998, 5, 1), shipped=None)], [line(1, 1, 1, "5")])
    r = revenue.order_transactions(m).collect()[0]
    assert r["Shipped_Date"] == D(1998, 5, 9)
    assert r["Shipping_Status"] == "In_Transit"
    assert float(r["Days_to_Ship"]) == 8.0
    assert shipping.shipping_report(m).collect()[0]["Delivery_Status"] == 0


def test_m3_on_time_boundary(spark):
    d = D(1997, 2, 1)
    m = make_marts(spark, [order(1, date=d, required=D(1997, 2, 10), shipped=D(1997, 2, 10)),
                           order(2, date=d, required=D(1997, 2, 10), shipped=D(1997, 2, 11))],
                   [line(1, 1, 1, "5"), line(2, 1, 1, "5")])
    got = dict(rows(shipping.shipping_report(m), "O_ID", "Delivery_Status"))
    assert got == {1: 1, 2: 0}


def test_m4_orphan_line_kept(spark):
    m = make_marts(spark, [order(1)], [line(1, 1, 2, "5"), line(99, 7, 3, "4")])
    rt = revenue.revenue_transactions(m)
    orphan = rt.where("O_ID = 99").collect()[0]
    assert orphan["O_Date"] is None and orphan["Shipping_Status"] == "In_Transit"
    # Left join + IS NULL keeps the orphan line next to unshipped orders.
    got = dict(rows(adhoc.unshipped_qty_by_product(m), "ProductID", "Total_ordered_Quantity"))
    assert got == {7: 3}


def _fanout_marts(spark):
    # Product 1 sells in 1996, 1997 and 1998; product 2 only in 1997.
    orders = [order(1, date=D(1997, 3, 1), freight="10.00"), order(2, date=D(1996, 8, 1)),
              order(3, date=D(1998, 2, 1))]
    details = [line(1, 1, 10, "2"), line(1, 2, 10, "3"), line(2, 1, 1, "2"), line(3, 1, 1, "2")]
    return make_marts(spark, orders, details)


def test_m5_fanout_shares_faithful_and_fixed(spark):
    m = _fanout_marts(spark)
    faithful = dict(rows(product.weighted_averages(m).where("Order_ID = 1"), "Product_ID", "WA_Q"))
    assert faithful == {1: pytest.approx(10 / 40), 2: pytest.approx(10 / 40)}
    fixed = dict(rows(product.weighted_averages_fixed(m).where("Order_ID = 1"), "Product_ID", "WA_Q"))
    assert fixed == {1: pytest.approx(0.5), 2: pytest.approx(0.5)}
    # Freight 10.00: faithful allocates 2.50 + 2.50, fixed 5.00 + 5.00.
    alloc = dict(rows(product.allocation(m).where("Order_ID = 1"), "Product_ID", "Allocated_Freight"))
    assert alloc == {1: M("2.5000"), 2: M("2.5000")}
    alloc_fixed = dict(rows(product.allocation_fixed(m).where("Order_ID = 1"), "Product_ID", "Allocated_Freight"))
    assert alloc_fixed == {1: M("5.0000"), 2: M("5.0000")}


def test_m6_identical_lines(spark):
    m = make_marts(spark, [order(1)], [line(1, 1, 2, "5"), line(1, 1, 2, "5")])
    assert product.weighted_averages(m).count() == 1
    assert product.weighted_averages_fixed(m).count() == 2


def test_m7_zero_discount_order(spark):
    m = make_marts(spark, [order(1)], [line(1, 1, 2, "5"), line(1, 2, 1, "5")])
    got = rows(product.weighted_averages_fixed(m), "WA_Discount")
    assert got == [(0.0,), (0.0,)]


def _country_orders(spec):
    """spec: list of (customer id, date, price) -> orders and lines."""
    orders, details = [], []
    for i, (cust, d, price) in enumerate(spec, start=1):
        orders.append(order(i, cust=cust, date=d))
        details.append(line(i, 1, 1, price))
    return orders, details


def test_m8_m9_gap_and_single_year_countries(spark):
    o, d = _country_orders([
        (1, D(1996, 9, 1), "100"), (1, D(1998, 2, 1), "300"),          # Norway: 1996 and 1998 only
        (2, D(1997, 5, 1), "50"),                                      # Poland: 1997 only
        (3, D(1996, 9, 1), "10"), (3, D(1997, 9, 1), "20"), (3, D(1998, 1, 5), "40"),
    ])
    g = {r["Country"]: r for r in growth.country_growth(make_marts(spark, o, d)).collect()}
    assert set(g) == {"Norway", "Denmark"}            # M9: Poland dropped
    nor = g["Norway"]
    assert nor["Sales_96"] == 0 and nor["Sales_97"] == 0   # M8: 1996 figures lost
    assert nor["YOY_98"] == pytest.approx(300 / 100 - 1)   # row lag: 1998 vs 1996
    assert g["Denmark"]["YOY_98"] == pytest.approx(40 / 20 - 1)
    assert g["Denmark"]["YOY_97"] == pytest.approx(20 / 10 - 1)


def test_m10_zero_base_growth_is_null(spark):
    from ledgerlens.operators.growth import pct_change
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0), ("b", 1, 2.0), ("b", 2, 3.0)], "k string, p int, v double")
    got = dict(((r["k"], r["p"]), r["g"]) for r in pct_change(df, ["k"], "p", "v", "g").collect())
    assert got[("a", 2)] is None and got[("a", 1)] is None
    assert got[("b", 2)] == pytest.approx(0.5)


def test_m11_aligned_growth_keeps_null(spark):
    o, d = _country_orders([
        (1, D(1997, 9, 1), "100"), (1, D(1998, 3, 1), "80"),   # no 1997-H1 row, no 1996 row
        (2, D(1996, 9, 1), "10"), (2, D(1997, 2, 1), "10"), (2, D(1997, 9, 1), "20"), (2, D(1998, 2, 1), "30"),
    ])
    m = make_marts(spark, o, d)
    acg = {r["Country"]: r for r in growth.actual_country_growth(m).collect()}
    assert acg["Norway"]["Sales_YOY_98_H1"] is None and acg["Norway"]["Sales_YOY_97_H2"] is None
    assert acg["Poland"]["Sales_YOY_97_H2"] == pytest.approx(1.0)
    assert acg["Poland"]["Sales_YOY_98_H1"] == pytest.approx(2.0)
    full = {r["Country"]: r for r in growth.country_growth(m).collect()}
    assert full["Norway"]["YOY_98"] is not None


def test_m12_m13_stock_classes(spark):
    products = [(1, "A", 1, 1, M("1"), 5, 10, 0),    # reorder >= stock, active -> Restock
                (2, "B", 1, 1, M("1"), 5, 10, 1),    # reorder >= stock, stopped -> Stopped
                (3, "C", 1, 1, M("1"), 50, 10, 0),   # reorder < stock, active -> Safe_Stock
                (4, "D", 1, 1, M("1"), 50, 10, 1),   # reorder < stock, stopped -> No_Restock
                (5, "E", 1, 1, M("1"), 50, None, 0)]  # NULL reorder level -> No_Restock
    m = make_marts(spark, [order(1)], [line(1, 1, 1, "1")], products=products)
    got = dict(rows(product.stock_status(m), "P_ID", "Stock_Status"))
    assert got == {1: "Restock", 2: "Stopped", 3: "Safe_Stock", 4: "No_Restock", 5: "No_Restock"}


def test_m14_case_insensitive_like(spark):
    m = make_marts(spark, [order(1, cust=1)], [line(1, 1, 1, "10")])
    got = rows(adhoc.net_purchases_by_year_country(m, patterns=("%norw%",)), "per_Year", "Net_Purchases")
    assert got == [(1997, M("10.0000"))]


def test_m15_null_courtesy_title(spark):
    m = make_marts(spark, [order(1, emp=6)], [line(1, 1, 1, "10")])
    assert rows(employee.employee_transactions(m), "Full_Name") == [(" F. Haddad",)]


def test_m16_running_average(spark):
    orders = [order(1, date=D(1996, 8, 1)), order(2, date=D(1996, 9, 1)), order(3, date=D(1997, 2, 1))]
    details = [line(1, 1, 10, "1"), line(2, 1, 20, "1"), line(3, 1, 30, "1")]
    got = dict(rows(product.allocation_summary(make_marts(spark, orders, details)), "per_Year", "Quantity_SOld"))
    assert got == {1996: 15, 1997: 20}


def test_m17_truncating_average(spark):
    orders = [order(1, date=D(1997, 1, 1), shipped=D(1997, 1, 9)), order(2, date=D(1997, 1, 1), shipped=D(1997, 1, 10))]
    r = adhoc.avg_days_to_ship(make_marts(spark, orders, [line(1, 1, 1, "1"), line(2, 1, 1, "1")])).collect()[0]
    assert r["Average_Days_to_Ship"] == 8
    assert r["Average_Days_to_Ship_Exact"] == pytest.approx(8.5)


def test_m18_null_freight(spark):
    m = make_marts(spark, [order(1, freight=None)], [line(1, 1, 1, "10")])
    assert customer.customer_transactions(m).collect()[0]["Amount_Paid"] is None


def test_new_customer_year_parameter(spark):
    o, d = _country_orders([(1, D(1998, 1, 5), "10"), (2, D(1997, 1, 5), "10")])
    got = dict(rows(customer.customer_classification(make_marts(spark, o, d)), "C_ID", "C_Classification"))
    assert got == {1: "New_Customer", 2: "Old_Customer"}
    got = dict(rows(customer.customer_classification(make_marts(spark, o, d, new_customer_year=1997)),
                    "C_ID", "C_Classification"))
    assert got == {1: "Old_Customer", 2: "New_Customer"}


def test_half_year_slices(spark):
    o, d = _country_orders([(1, D(1996, 8, 1), "1"), (1, D(1997, 3, 1), "2"), (1, D(1997, 8, 1), "4"),
                            (1, D(1998, 4, 1), "8")])
    m = make_marts(spark, o, d)
    h2 = {r["Year"]: r["Annual_Sales"] for r in country_plans.country_transactions_h2(m).collect()}
    h1 = {r["Year"]: r["Annual_Sales"] for r in country_plans.country_transactions_h1(m).collect()}
    assert h2 == {1996: M("1"), 1997: M("4")}
    assert h1 == {1997: M("2"), 1998: M("8")}
    ids = {r["Country_ID"] for r in country_plans.country_transactions_h2(m).collect()}
    assert ids == {"1996H2-Nor", "1997H2-Nor"}


def test_employee_positions(spark):
    orders = [order(i, emp=e) for i, e in ((1, 1), (2, 2), (3, 5))]
    got = dict(rows(employee.employee_transactions(make_marts(spark, orders, [line(i, 1, 1, "1") for i in (1, 2, 3)])),
                    "Emp_ID", "Position"))
    assert got == {1: "Manager", 2: "Supervisor", 5: "Employee"}


def test_employee_performance_status_rows(spark):
    orders = [order(1, emp=3, date=D(1997, 4, 2)), order(2, emp=3, date=D(1997, 4, 9), shipped=None)]
    m = make_marts(spark, orders, [line(1, 1, 1, "1"), line(2, 1, 1, "1")])
    got = sorted(rows(employee.employee_performance(m), "Delivered_Orders", "Delayed_Orders"), key=str)
    assert got == sorted([(1, None), (None, 1)], key=str)
    wide = employee.employee_performance_wide(m).collect()[0]
    assert (wide["Delivered_Orders"], wide["Delayed_Orders"], wide["Orders_Made"]) == (1, 1, 2)


def test_p_sales_divisor_quirk(spark):
    # 1997-H2 rows of P_Sales_H2 are divided by the 1996 totals; the fixed
    # report uses the 1997-H2 totals.
    orders = [order(1, date=D(1996, 9, 1)), order(2, date=D(1997, 9, 1)), order(3, date=D(1997, 10, 1))]
    details = [line(1, 1, 1, "10"), line(2, 1, 1, "30"), line(3, 2, 1, "10")]
    m = make_marts(spark, orders, details)
    faithful = {(r["per_Year"], r["Product_ID"]): r for r in product.p_sales_h2(m).collect()}
    fixed = {(r["per_Year"], r["Product_ID"]): r for r in product.p_sales_h2_fixed(m).collect()}
    assert faithful[(1997, 1)]["NS_pct"] == pytest.approx(30 / 10)
    assert fixed[(1997, 1)]["NS_pct"] == pytest.approx(30 / 40)
    assert faithful[(1997, 1)]["SP_Order"] == pytest.approx(30 / 1)
    assert fixed[(1997, 1)]["SP_Order"] == pytest.approx(30 / 2)


def test_window_filter_reaches_scan(spark):
    from ledgerlens.sources.tables import load_sales_tables
    t = load_sales_tables(spark, "/root/testdata/sf0.001", window=(D(1996, 7, 1), D(1998, 5, 7)))
    plan = t.orders._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    q = revenue.revenue_transactions(Marts_load(spark)).where(F.col("O_Date") >= F.lit(D(1997, 7, 1)))
    assert "o_orderdate" in q._jdf.queryExecution().executedPlan().toString()


def Marts_load(spark):
    from ledgerlens.plans.context import Marts
    return Marts.load(spark, "/root/testdata/sf0.001", persist=False)


def test_line_without_product_keeps_order_totals(spark):
    m = make_marts(spark, [order(1, freight="9.00")],
                   [line(1, 1, 2, "5"), (1, None, 1, M("5"), M("0"), M("5"))])
    fixed = product.weighted_averages_fixed(m).collect()
    assert sum(r["WA_Q"] for r in fixed) == pytest.approx(1.0)
    alloc = sum(r["Allocated_Freight"] for r in product.allocation_fixed(m).collect())
    assert alloc == M("9.0000")
    faithful = {r["Product_ID"]: r["WA_Q"] for r in product.weighted_averages(m).collect()}
    assert faithful[None] == pytest.approx(1 / 3) and faithful[1] == pytest.approx(2 / 3)


def test_m16_year_frame_option(spark):
    orders = [order(1, date=D(1996, 8, 1)), order(2, date=D(1996, 9, 1)), order(3, date=D(1997, 2, 1))]
    details = [line(1, 1, 10, "1"), line(2, 1, 20, "1"), line(3, 1, 30, "1")]
    m = make_marts(spark, orders, details)
    got = dict(rows(product.allocation_summary(m, frame="year"), "per_Year", "Quantity_SOld"))
    assert got == {1996: 15, 1997: 30}


def test_m11_fill_zero_option(spark):
    o, d = _country_orders([(1, D(1997, 9, 1), "100"), (1, D(1998, 3, 1), "80")])
    m = make_marts(spark, o, d)
    row = growth.actual_country_growth(m, fill_zero=True).collect()[0]
    assert row["Sales_YOY_97_H2"] == 0 and row["Sales_YOY_98_H1"] == 0


def test_g5_row_vs_calendar_lag(spark):
    o, d = _country_orders([(1, D(1995, 3, 1), "10"), (1, D(1996, 3, 1), "20"), (1, D(1998, 3, 1), "60")])
    m = make_marts(spark, o, d)
    row = {r["Year"]: r["Sales_YOY"] for r in growth.growth_long(m).collect()}
    cal = {r["Year"]: r["Sales_YOY"] for r in growth.growth_long(m, calendar=True).collect()}
    assert row[1996] == pytest.approx(1.0) and row[1998] == pytest.approx(2.0)
    assert cal[1996] == pytest.approx(1.0) and cal[1998] is None


def test_g6_aligned_halves_and_cutoff(spark):
    o, d = _country_orders([(1, D(1996, 2, 1), "10"), (1, D(1996, 9, 1), "100"),
                            (1, D(1997, 2, 1), "15"), (1, D(1997, 6, 20), "5"), (1, D(1997, 9, 1), "50")])
    m = make_marts(spark, o, d)
    got = {(r["Year"], r["Half"]): r["Aligned_YOY"] for r in growth.period_aligned_growth(m).collect()}
    assert got[(1997, "H1")] == pytest.approx(20 / 10 - 1)
    assert got[(1997, "H2")] == pytest.approx(50 / 100 - 1)
    assert got[(1996, "H1")] is None
    cut = {(r["Year"], r["Half"]): r["Aligned_YOY"] for r in growth.period_aligned_growth(m, cutoff=(5, 6)).collect()}
    assert cut[(1997, "H1")] == pytest.approx(15 / 10 - 1)       # 20 June 1997 is past the cutoff
    assert (1997, "H2") not in cut


def test_g7_comparison_keeps_full_year_rows(spark):
    o, d = _country_orders([(1, D(1996, 9, 1), "10"), (1, D(1997, 2, 1), "10"), (1, D(1997, 9, 1), "20"),
                            (1, D(1998, 2, 1), "30"), (2, D(1998, 2, 1), "5")])
    m = make_marts(spark, o, d)
    got = {r["Country"]: r for r in growth.growth_comparison(m).collect()}
    assert set(got) == {"Norway", "Poland"}
    assert got["Norway"]["Sales_YOY_98_H1"] == pytest.approx(2.0)
    assert got["Poland"]["Sales_YOY_97_H2"] is None and got["Poland"]["YOY_98"] == 0


def test_kpi_delivery_and_top_shipper(spark):
    from ledgerlens.plans import kpi
    d = D(1997, 3, 1)
    orders = [order(1, date=d, via=1, required=D(1997, 3, 10), shipped=D(1997, 3, 5), freight="5"),
              order(2, date=d, via=2, required=D(1997, 3, 10), shipped=D(1997, 3, 12), freight="7"),
              order(3, date=d, via=2, shipped=None, freight="7"),
              order(4, date=d, via=3, required=D(1997, 3, 10), shipped=D(1997, 3, 9), freight="1")]
    m = make_marts(spark, orders, [line(i, 1, 1, "10") for i in (1, 2, 3, 4)])
    r = kpi.delivery_performance(m).first()
    assert (r["Shipped_Orders"], r["On_Time_Orders"], r["Orders"]) == (3, 2, 4)
    top = kpi.top_freight_shipper_by_year(m).first()
    assert top["Shipping_Company"] == "Bluewave Cargo" and top["Freight"] == M("14.0000")
    # Tie on on-time deliveries (Atlas 1, Comet 1): the alphabetically first wins.
    assert kpi.top_on_time_shipper_by_year(m).first()["Shipping_Company"] == "Atlas Freight"


def test_kpi_stock_mix_shares(spark):
    from ledgerlens.plans import kpi
    products = [(1, "A", 1, 1, M("1"), 5, 10, 0), (2, "B", 1, 1, M("1"), 50, 10, 0),
                (3, "C", 1, 1, M("1"), 50, 10, 1), (4, "D", 1, 1, M("1"), 60, 10, 0)]
    m = make_marts(spark, [order(1)], [line(1, p, 1, "1") for p in (1, 2, 3, 4)], products=products)
    got = {(r["Discontinued"], r["Stock_Status"]): (r["Rows"], r["Pct_of_All"], r["Pct_of_Flag"])
           for r in kpi.stock_status_mix(m).collect()}
    assert got[(0, "Safe_Stock")] == (2, pytest.approx(0.5), pytest.approx(2 / 3))
    assert got[(0, "Restock")] == (1, pytest.approx(0.25), pytest.approx(1 / 3))
    assert got[(1, "No_Restock")] == (1, pytest.approx(0.25), pytest.approx(1.0))

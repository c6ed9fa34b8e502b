"""Headline KPIs (K1-K17) of the sales dashboards.

All are aggregates over the marts; "top" figures use an aggregate top-1
(``min_by`` over a struct key) rather than a sort + limit, so they stay
single-pass and skew-safe. Only ``best_months`` keeps a limit: a top-k list
is the feature there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import money
from ledgerlens.operators.ranking import top1, top1_per_group
from ledgerlens.plans.context import Marts
from ledgerlens.plans.country import country_transactions
from ledgerlens.plans.customer import customer_classification, customer_transactions
from ledgerlens.plans.product import allocated_lines, category_performance, product_details, with_names
from ledgerlens.plans.revenue import monthly_transactions, order_lines, revenue_transactions
from ledgerlens.plans.shipping import shipping_report

# Years that have a pivot column in any case: those of the given orders.
YEARS = list(range(1995, 2002))


def pivot_columns(m: Marts) -> list[int]:
    """YEARS and any other year that the orders have (one small aggregate)."""
    found = m.t.orders.select(F.year("OrderDate").alias("y")).where("y IS NOT NULL").distinct().collect()
    return sorted({*YEARS, *(r.y for r in found)})


def orders_summary(m: Marts) -> DataFrame:
    """K1: orders, ordering customers, quantity sold."""
    o = order_lines(m)
    return o.agg(F.count("O_ID").alias("Orders"),
                 F.countDistinct("C_ID").alias("Customers"),
                 F.sum("Quantity_Sold").alias("Quantity"))


def shipping_efficiency(m: Marts) -> DataFrame:
    """K2: average days to ship over all orders (in-transit orders count with
    their imputed date), plus the share of shipped orders."""
    o = order_lines(m)
    return o.agg(
        F.try_divide(F.sum("Days_to_Ship").cast("double"), F.count("Days_to_Ship").cast("double")).alias("Avg_Days_to_Ship"),
        F.count("O_ID").alias("Orders"),
        F.count_if(F.col("Shipping_Status") == "Shipped").alias("Shipped_Orders"))


def catalogue_counts(m: Marts) -> DataFrame:
    """K3: categories and products in the catalogue."""
    p = m.t.products
    return p.agg(F.countDistinct("CategoryID").alias("Categories"),
                 F.countDistinct("ProductID").alias("Products"))


def sales_totals(m: Marts) -> DataFrame:
    """K4: gross sales, discounts, net sales, profit and freight."""
    o = order_lines(m)
    return o.agg(F.sum("O_Total_Sales").alias("Gross_Sales"),
                 F.sum("O_Discount_Amount").alias("Discounts"),
                 F.sum("O_Net_Sales").alias("Net_Sales"),
                 F.sum("O_Net_Profit").alias("Net_Profit"),
                 F.sum("Freight").alias("Freight"))


def best_month(m: Marts) -> DataFrame:
    """K5: the month with the highest net sales."""
    return top1(monthly_transactions(m), "Monthly_Net_Sales", ["per_Year", "per_Month"],
                ["Date_ID", "per_Year", "per_Month", "Monthly_Net_Sales", "Monthly_Orders"])


def best_months(m: Marts, n: int = 5) -> DataFrame:
    """S2 head(n): the n best months by net sales (a top-k report)."""
    mt = monthly_transactions(m)
    return mt.orderBy(F.col("Monthly_Net_Sales").desc(), "per_Year", "per_Month").limit(n) \
        .select("Date_ID", "per_Year", "per_Month", "Monthly_Net_Sales")


def top_country_by_year(m: Marts) -> DataFrame:
    """K6: top country by net sales in each year."""
    return top1_per_group(country_transactions(m), ["Year"], "Annual_Sales", ["Country"],
                          ["Country", "Annual_Sales"])


def country_most_customers(m: Marts) -> DataFrame:
    """K7: the country with the most registered customers."""
    c = m.t.customers.groupBy("Country").agg(F.count("CustomerID").alias("No_of_Customers"))
    return top1(c, "No_of_Customers", ["Country"], ["Country", "No_of_Customers"])


def country_discount_rank(m: Marts) -> DataFrame:
    """K8: per year, the country with the highest discounts and the country
    with the highest net sales."""
    rt = revenue_transactions(m)
    g = rt.groupBy(F.year("O_Date").alias("Year"), "Country").agg(
        F.sum("Discount_Amount").alias("Discount"), F.sum("Detailed_Net_Sales").alias("Net_Sales"))
    d = top1_per_group(g, ["Year"], "Discount", ["Country"], ["Country", "Discount"]) \
        .withColumnRenamed("Country", "Top_Discount_Country")
    n = top1_per_group(g, ["Year"], "Net_Sales", ["Country"], ["Country", "Net_Sales"]) \
        .withColumnRenamed("Country", "Top_Net_Sales_Country")
    return d.join(n, "Year", "full")


def amount_paid_total(m: Marts) -> DataFrame:
    """K9: total paid by customers including freight."""
    ct = customer_transactions(m)
    return ct.agg(F.sum("Amount_Paid").alias("Amount_Paid"),
                  F.sum("Net_Purchases").alias("Net_Purchases"),
                  F.sum("Freight").alias("Freight"))


def new_customers_by_class(m: Marts) -> DataFrame:
    """Customers per class (new = first order in the new-customer year)."""
    return customer_classification(m).groupBy("C_Classification").agg(F.count("C_ID").alias("No_of_Customers"))


def monthly_active_customers(m: Marts) -> DataFrame:
    """Distinct ordering customers per month."""
    o = order_lines(m)
    return o.groupBy("per_Year", "per_Month").agg(F.countDistinct("C_ID").alias("Active_Customers"))


def stock_status_mix(m: Marts) -> DataFrame:
    """Product-year rows per (discontinued flag, stock status), as a share
    of all rows and of the rows with the same flag, and the products behind them
    (a product has a row for each year it sold in). The grouped table has at
    most 2 x 4 rows, so the totals are taken with a global window on it."""
    g = product_details(m).groupBy("Discontinued", "Stock_Status").agg(
        F.count(F.lit(1)).alias("Rows"), F.countDistinct("P_ID").alias("Products"))
    all_rows = F.sum("Rows").over(Window.partitionBy())
    flag_rows = F.sum("Rows").over(Window.partitionBy("Discontinued"))
    return g.select("Discontinued", "Stock_Status", "Rows", "Products",
                    F.try_divide(F.col("Rows").cast("double"), all_rows.cast("double")).alias("Pct_of_All"),
                    F.try_divide(F.col("Rows").cast("double"), flag_rows.cast("double")).alias("Pct_of_Flag"),
                    F.try_divide(F.col("Products").cast("double"), F.sum("Products").over(Window.partitionBy()).cast("double")).alias("Pct_of_Products"))


def top_category(m: Marts) -> DataFrame:
    """Category totals over all years including allocated freight; the
    best category by net sales."""
    per_product = allocated_lines(m, True).groupBy("Product_ID").agg(
        money.sum_units(F.col("__u_Allocated_Freight"), 2).alias("Freight"))
    a = with_names(m, per_product).groupBy("Category").agg(F.sum("Freight").alias("Freight"))
    c = category_performance(m).groupBy("Category").agg(
        F.sum("Category_N_Sales").alias("Net_Sales"),
        F.sum("Category_Net_Profit").alias("Net_Profit"),
        F.sum("Category_Discount").alias("Discount"))
    j = c.join(a, "Category", "left")
    return top1(j, "Net_Sales", ["Category"], ["Category", "Net_Sales", "Net_Profit", "Discount", "Freight"])


def top_freight_shipper_by_year(m: Marts) -> DataFrame:
    """Per year, the shipper with the highest freight."""
    g = shipping_report(m).groupBy("per_Year", "Shipping_Company").agg(F.sum("Freight").alias("Freight"))
    return top1_per_group(g, ["per_Year"], "Freight", ["Shipping_Company"], ["Shipping_Company", "Freight"])


def delivery_performance(m: Marts) -> DataFrame:
    """Shipped orders and orders delivered on time."""
    s = shipping_report(m)
    return s.agg(F.count_if(F.col("Shipping_Status") == "Shipped").alias("Shipped_Orders"),
                 F.sum("Delivery_Status").alias("On_Time_Orders"),
                 F.count("O_ID").alias("Orders"))


def top_on_time_shipper_by_year(m: Marts) -> DataFrame:
    """Per year, the shipper with the most on-time deliveries."""
    g = shipping_report(m).groupBy("per_Year", "Shipping_Company").agg(
        F.sum("Delivery_Status").alias("On_Time_Orders"))
    return top1_per_group(g, ["per_Year"], "On_Time_Orders", ["Shipping_Company"],
                          ["Shipping_Company", "On_Time_Orders"])


def sales_pivot_country(m: Marts, years=None) -> DataFrame:
    """Net sales pivot, country x year."""
    years = years or pivot_columns(m)
    ct = country_transactions(m)
    return ct.groupBy("Country").pivot("Year", years).agg(F.sum("Annual_Sales")) \
        .withColumnsRenamed({str(y): f"Sales_{y}" for y in years})


def sales_pivot_category(m: Marts, years=None) -> DataFrame:
    """Net sales pivot, category x year."""
    years = years or pivot_columns(m)
    cp = category_performance(m)
    return cp.groupBy("Category").pivot("per_Year", years).agg(F.sum("Category_N_Sales")) \
        .withColumnsRenamed({str(y): f"Sales_{y}" for y in years})

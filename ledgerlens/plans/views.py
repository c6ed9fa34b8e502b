"""The marts under the source's view and table names, for SQL users.

``register_views(m)`` creates a temporary view per mart, so queries written
against the source names (``SELECT * FROM Shipping_Report_H1``) run
unchanged through ``spark.sql``; every view stays a lazy plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.plans import country, customer, employee, growth, product, revenue, shipping
from ledgerlens.operators.quality import Rules
from ledgerlens.plans.context import Marts
from ledgerlens.sources.sinks import publish_table

# The source's view and table names (spelling as in the source).
SOURCE_NAMES = {
    "Revnue_Transactions": revenue.revenue_transactions,
    "Order_Transactions": revenue.order_transactions,
    "Monthly_Transactions": revenue.monthly_transactions,
    "Country_Transactions": country.country_transactions,
    "Country_Transactions_H2": country.country_transactions_h2,
    "Country_Transactions_H1": country.country_transactions_h1,
    "Customer_Transactions": customer.customer_transactions,
    "Customer_Classification": customer.customer_classification,
    "Customer_Summary": customer.customer_summary,
    "Product_Transactions": product.product_transactions,
    "Product_Details": product.product_details,
    "Weighted_Averages": product.weighted_averages,
    "Allocation": product.allocation,
    "Allocation_H2": product.allocation_h2,
    "Allocation_H1": product.allocation_h1,
    "Allocation_Summary": product.allocation_summary,
    "Products_Report": product.products_report,
    "Discount_96": product.discount_96,
    "Discount_97_H1": product.discount_97_h1,
    "Discount_97_H2": product.discount_97_h2,
    "Discount_98": product.discount_98,
    "P_Sales_H2": product.p_sales_h2,
    "P_Sales_H1": product.p_sales_h1,
    "Category_Performance": product.category_performance,
    "Employee_Transactions": employee.employee_transactions,
    "Employee_performance": employee.employee_performance,
    "Shipping_Report": shipping.shipping_report,
    "Shipping_Report_H2": shipping.shipping_report_h2,
    "Shipping_Report_H1": shipping.shipping_report_h1,
    "Country_Growth": growth.country_growth,
    "Actual_Country_Growth": growth.actual_country_growth,
    "Product_Growth": growth.product_growth,
    "Actual_Product_Growth": growth.actual_product_growth,
}


def view(m: Marts, name: str) -> DataFrame:
    """A mart by its source name."""
    return SOURCE_NAMES[name](m)


def register_views(m: Marts, names=None) -> list[str]:
    """Register marts as temporary views under the source names."""
    done = []
    for name in names or SOURCE_NAMES:
        SOURCE_NAMES[name](m).createOrReplaceTempView(name)
        done.append(name)
    return done


GROWTH_TABLES = ("Country_Growth", "Actual_Country_Growth", "Product_Growth", "Actual_Product_Growth")


# The constraints that the source puts on its stored growth tables.
GROWTH_RULES = {
    "Country_Growth": Rules(("Country",), (), {"Country": 15}),
    "Actual_Country_Growth": Rules(("Country",), (), {"Country": 15}),
    "Product_Growth": Rules(("Product_ID", "Product_Name", "Category"), ("Product_ID",), {"Product_Name": 40, "Category": 15}),
    "Actual_Product_Growth": Rules(("Product_ID", "Product_Name", "Category"), ("Product_ID",), {"Product_Name": 40, "Category": 15}),
}


def save_growth_tables(m: Marts, root: str | None = None) -> dict[str, str]:
    """Store the four growth tables in the catalog, under their constraints. A
    table that exists or whose rows break a rule fails, and is not published.
    Returns table name -> folder."""
    return {name: publish_table(SOURCE_NAMES[name](m), name, GROWTH_RULES[name], root) for name in GROWTH_TABLES}

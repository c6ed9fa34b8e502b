"""Ad-hoc analyses (H1-H8): unshipped orders, shipping days, filtered growth
and drill-downs.

Name patterns are parameters; the registered queries pass patterns that exist
in the provided tables (country names there are ``NATION_<n>``), lower-cased
to exercise the case-insensitive match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import dates, money
from ledgerlens.functions.text import like_any
from ledgerlens.plans.context import Marts
from ledgerlens.plans.customer import customer_transactions
from ledgerlens.plans.growth import (actual_country_growth, actual_product_growth, country_growth,
                                     product_growth)
from ledgerlens.plans.revenue import revenue_transactions

COUNTRY_PREFIXES = ("nation_1%", "nation_2%")
DRILL_PREFIX = ("nation_7%",)
COUNTRY_FRAGMENT = ("%ion_1%",)
PRODUCT_IDS = (1, 5)


def unshipped_orders(m: Marts) -> DataFrame:
    """H1: orders without a ship date."""
    o = m.t.orders
    return o.where(F.col("ShippedDate").isNull()).select("OrderID", "OrderDate", "ShippedDate", "ShipVia", "Freight")


def unshipped_qty_by_product(m: Marts) -> DataFrame:
    """H2: ordered quantity per product on orders without a ship date.

    Left join then ``IS NULL`` on the right side: keeps lines of unshipped
    orders *and* lines whose order is missing (not an anti join)."""
    od = m.t.order_details
    o = m.t.orders.select("OrderID", "ShippedDate")
    j = od.join(o, "OrderID", "left").where(F.col("ShippedDate").isNull())
    return j.groupBy("ProductID").agg(F.sum("Quantity").alias("Total_ordered_Quantity"))


def avg_days_to_ship(m: Marts) -> DataFrame:
    """H3: average order-to-ship days over shipped orders; the integer average
    truncates (source semantics), the exact average is reported next to it."""
    o = m.t.orders
    d = dates.days_between(F.col("OrderDate"), F.col("ShippedDate"))
    g = o.agg(F.sum(d).alias("s"), F.count(d).alias("n"))
    trunc = F.when(F.col("n") > 0, F.call_function("div", F.col("s"), F.col("n")))
    return g.select(trunc.cast("int").alias("Average_Days_to_Ship"),
                    money.ratio(F.col("s"), F.col("n")).alias("Average_Days_to_Ship_Exact"))


def growth_by_country_like(m: Marts, patterns=COUNTRY_PREFIXES) -> DataFrame:
    """H4 (full-year table): Country, YOY_97, YOY_98 for name prefixes."""
    return country_growth(m).where(like_any(F.col("Country"), patterns)).select("Country", "YOY_97", "YOY_98")


def actual_growth_by_country_like(m: Marts, patterns=COUNTRY_PREFIXES) -> DataFrame:
    """H4 (aligned table) for the same prefixes."""
    return actual_country_growth(m).where(like_any(F.col("Country"), patterns))


def country_line_drilldown(m: Marts, patterns=DRILL_PREFIX) -> DataFrame:
    """H5: date, country and net sales of every line for a country prefix."""
    rt = revenue_transactions(m)
    return rt.where(like_any(F.col("Country"), patterns)).select("O_Date", "Country", "Detailed_Net_Sales")


def net_purchases_by_year_country(m: Marts, patterns=COUNTRY_FRAGMENT) -> DataFrame:
    """H6: yearly net purchases of customers whose country contains a fragment."""
    ct = customer_transactions(m)
    return (ct.where(like_any(F.col("C_Country"), patterns))
              .groupBy("per_Year").agg(F.sum("Net_Purchases").alias("Net_Purchases")))


def customer_counts(m: Marts) -> DataFrame:
    """H7: registered customers vs customers with at least one order line."""
    registered = m.t.customers.agg(F.countDistinct("CustomerID").alias("No_of_Customers")) \
        .select(F.lit("Customers").alias("Source"), "No_of_Customers")
    ordering = revenue_transactions(m).agg(F.countDistinct("C_ID").alias("No_of_Customers")) \
        .select(F.lit("Revnue_Transactions").alias("Source"), "No_of_Customers")
    return registered.unionByName(ordering)


def growth_by_product(m: Marts, ids=PRODUCT_IDS) -> DataFrame:
    """H8 (full-year table): growth rows of selected products."""
    cond = None
    for i in ids:
        c = F.col("Product_ID") == F.lit(i)
        cond = c if cond is None else (cond | c)
    return product_growth(m).where(cond)


def actual_growth_by_product(m: Marts, ids=PRODUCT_IDS) -> DataFrame:
    """H8 (aligned table) for the same products."""
    return actual_product_growth(m).where(F.col("Product_ID").isin(list(ids)))

"""Shipping marts: V27 order-level shipping report, V28/V29 shipper half-year
reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import dates, money
from ledgerlens.functions.text import concat_strict, left
from ledgerlens.plans.context import Marts, mart
from ledgerlens.plans.revenue import SHIPPED, customer_orders

SHIPPING_COLUMNS = [
    "per_Year", "ODate", "Required_Date", "Shipped_Date", "O_ID", "Days_to_Ship", "O_Date", "C_ID",
    "Country", "E_ID", "O_Net_Sales", "Q_Shipped", "Freight", "Shipping_Company", "Shipping_Status",
    "Delivery_Status",
]


@mart
def shipping_report(m: Marts) -> DataFrame:
    """One row per order with its shipper and the on-time flag (shipped,
    and not after the required date)."""
    o = customer_orders(m)
    s = m.t.shippers.select(F.col("ShipperID").alias("ShipVia"), F.col("CompanyName").alias("Shipping_Company"))
    j = o.join(s, "ShipVia", "left")
    on_time = F.when((F.col("Shipped_Date") <= F.col("Required_Date")) & (F.col("Shipping_Status") == SHIPPED),
                     F.lit(1)).otherwise(F.lit(0))
    return j.select("per_Year", F.col("O_Date").alias("ODate"), "Required_Date", "Shipped_Date", "O_ID",
                    "Days_to_Ship", "O_Date", "C_ID", "Country", "E_ID", "O_Net_Sales",
                    F.col("Quantity_Sold").alias("Q_Shipped"), "Freight", "Shipping_Company",
                    "Shipping_Status", on_time.alias("Delivery_Status"))


def shipper_half_report(m: Marts, slices, tag: str) -> DataFrame:
    """Shipper-year figures over half-year slices; freight shares are taken of
    each slice's own total."""
    sr = shipping_report(m).where(dates.in_any(F.col("ODate"), slices))
    g = sr.groupBy("per_Year", "Shipping_Company").agg(
        F.count("O_ID").alias("Handeled_Orders"),
        F.sum("O_Net_Sales").alias("Net_Sales_of_Shipped"),
        F.sum("Freight").alias("Shipping_Cost"),
        F.sum(money.to_units(F.col("Days_to_Ship"), 2)).alias("__days_units"),
        F.count("Days_to_Ship").alias("__days_n"),
        F.sum("Delivery_Status").alias("__on_time"))
    # A year's freight: over its shippers' rows, a handful.
    g = g.withColumn("__period_freight", F.sum("Shipping_Cost").over(Window.partitionBy("per_Year")))
    on_time_pct = money.from_units(money.div_half_up(F.col("__on_time") * F.lit(10_000), F.col("Handeled_Orders")), 4)
    year_id = concat_strict(F.col("per_Year").cast("string"), f"{tag}-", left(F.col("Shipping_Company"), 1))
    return g.select(
        year_id.alias("Year_ID"), "per_Year", "Shipping_Company", "Handeled_Orders",
        "Net_Sales_of_Shipped", "Shipping_Cost",
        money.avg_rounded(F.col("__days_units"), F.col("__days_n"), 2, 2).cast("decimal(10,2)").alias("Avg_Days_to_Ship"),
        money.ratio(F.col("Shipping_Cost"), F.col("__period_freight")).alias("Shipping_Cost_WA"),
        on_time_pct.cast("decimal(10,4)").alias("On_Time_Delivery_pct"),
        money.ratio(F.col("Shipping_Cost"), F.col("Handeled_Orders")).alias("Avg_Freight_per_Order"),
    )


@mart
def shipping_report_h2(m: Marts) -> DataFrame:
    """July-December 1996 and 1997."""
    return shipper_half_report(m, dates.H2_SLICES, "H2")


@mart
def shipping_report_h1(m: Marts) -> DataFrame:
    """January-June 1997 and 1998."""
    return shipper_half_report(m, dates.H1_SLICES, "H1")

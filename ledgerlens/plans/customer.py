"""Customer marts: V7 customer-order purchases, V8 classification, V9 summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import concat_strict, left
from ledgerlens.plans.context import Marts, mart
from ledgerlens.plans.revenue import customer_orders

NEW = "New_Customer"
OLD = "Old_Customer"

CUSTOMER_TX_COLUMNS = [
    "per_Year", "C_ID", "CO_Name", "C_Country", "O_ID", "Q_Purchased", "Total_Purchases",
    "Discount", "Net_Purchases", "Profit_Generated", "Freight", "Amount_Paid", "Shipping_Status",
]


@mart
def customer_transactions(m: Marts) -> DataFrame:
    """V7: purchases per customer order; amount paid = net purchases + freight
    (NULL freight gives a NULL amount). Every grouping key of the view is a
    function of the order id, so this is a projection of the order grain."""
    o = customer_orders(m)
    return o.select(
        "per_Year", "C_ID",
        left(F.col("_CompanyName"), 15).alias("CO_Name"),
        F.col("Country").alias("C_Country"),
        "O_ID",
        F.col("Quantity_Sold").alias("Q_Purchased"),
        F.col("O_Total_Sales").alias("Total_Purchases"),
        F.col("O_Discount_Amount").alias("Discount"),
        F.col("O_Net_Sales").alias("Net_Purchases"),
        F.col("O_Net_Profit").alias("Profit_Generated"),
        "Freight",
        (F.col("O_Net_Sales") + F.col("Freight")).alias("Amount_Paid"),
        "Shipping_Status",
    )


@mart
def customer_classification(m: Marts) -> DataFrame:
    """V8: ``New_Customer`` when the first order year is ``m.new_customer_year``."""
    o = customer_orders(m)
    g = o.groupBy("C_ID", left(F.col("_CompanyName"), 15).alias("C_Name")).agg(
        F.min("per_Year").alias("_first_year"))
    cls = F.when(F.col("_first_year") == m.new_customer_year, F.lit(NEW)).otherwise(F.lit(OLD))
    return g.select("C_ID", "C_Name", cls.alias("C_Classification"))


@mart
def customer_summary(m: Marts) -> DataFrame:
    """V9: customer-year totals with the class. Aggregated before joining the
    class (one row per customer), so the join runs at customer-year grain."""
    ct = customer_transactions(m)
    g = ct.groupBy("per_Year", "C_ID", "CO_Name", "C_Country").agg(
        F.count("O_ID").alias("Total_Orders"),
        F.sum("Q_Purchased").alias("Purchased_Q"),
        F.sum("Total_Purchases").alias("Purchases"),
        F.sum("Discount").alias("Discount"),
        F.sum("Net_Purchases").alias("Net_Purchases"),
        F.sum("Profit_Generated").alias("Profit_Generated"),
        F.sum("Freight").alias("Freight"),
    )
    cc = customer_classification(m).select("C_ID", "C_Classification")
    j = g.join(cc, "C_ID", "left")
    year_id = concat_strict(F.col("per_Year").cast("string"), "-", left(F.col("C_ID").cast("string"), 2))
    return j.select(
        year_id.alias("Year_ID"), "per_Year", "C_ID", "CO_Name", "C_Country", "Total_Orders",
        "Purchased_Q", "Purchases", "Discount", "Net_Purchases", "Profit_Generated", "Freight",
        (F.col("Net_Purchases") + F.col("Freight")).alias("Amount_Paid"), "C_Classification")

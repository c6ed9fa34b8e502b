"""Country marts: V4 annual totals and the V5/V6 half-year slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import dates
from ledgerlens.functions.text import concat_strict, left
from ledgerlens.plans.context import Marts, mart
from ledgerlens.plans.revenue import customer_orders, lines_in

COUNTRY_COLUMNS = ["Country", "Country_ID", "Year", "Annual_Sales", "Annual_Profit"]


def _country_year(rows: DataFrame, id_tag: str, sales: str = "O_Net_Sales", profit: str = "O_Net_Profit") -> DataFrame:
    # Country has a handful of values: map-side partial aggregation collapses
    # each partition to a few rows before the shuffle, whatever the skew.
    g = rows.groupBy("Country", F.year("O_Date").alias("Year")).agg(
        F.sum(sales).alias("Annual_Sales"), F.sum(profit).alias("Annual_Profit"))
    cid = concat_strict(F.col("Year").cast("string"), id_tag, left(F.col("Country"), 3))
    return g.select("Country", cid.alias("Country_ID"), "Year", "Annual_Sales", "Annual_Profit")


@mart
def country_transactions(m: Marts) -> DataFrame:
    """V4: net sales and profit per country and year."""
    return _country_year(customer_orders(m), "-")


def country_slices(m: Marts, periods, tag: str) -> DataFrame:
    """Country totals over a union of disjoint period slices, one scan: of the
    stored half-years where there are such, else of the order grain."""
    if m.line_store:
        return _country_year(lines_in(m, periods), tag, "Detailed_Net_Sales", "Detailed_Net_Profit")
    return _country_year(customer_orders(m).where(dates.in_any(F.col("O_Date"), periods)), tag)


@mart
def country_transactions_h2(m: Marts) -> DataFrame:
    """V5: July-December 1996 and 1997."""
    return country_slices(m, dates.H2_SLICES, "H2-")


@mart
def country_transactions_h1(m: Marts) -> DataFrame:
    """V6: January-June 1997 and 1998."""
    return country_slices(m, dates.H1_SLICES, "H1-")

"""Growth tables (G1-G4) and generic growth jobs.

G1-G4 reproduce the notebook: sort, ``pct_change`` per entity (previous
*row*), ``fillna(0)`` where the notebook fills, then reshape the long table
to one row per entity with pandas-style natural merges whose kept side
decides which entities survive (expressed as one presence pivot per table,
so the upstream plan is not copied into every merged slice):

* G1 country growth: right merges -> countries present in 1998; a country
  missing in 1997 loses its 1996 figures.
* G2 aligned country growth: countries in 1997-H2 and in 1998-H1.
* G3 product growth: left merges from 1997 -> products present in 1997.
* G4 aligned product growth: products present in 1998-H1.

Every input here is already one row per entity and period, so the window and
the pivot run on small per-entity groups and share the partitioning by entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.growth import calendar_change, pct_change
from ledgerlens.operators.reshape import fill_numeric, natural_merge, presence_pivot
from ledgerlens.plans.context import Marts, mart
from ledgerlens.plans.country import country_transactions, country_transactions_h1, country_transactions_h2
from ledgerlens.plans.product import p_sales_h1, p_sales_h2, products_report

COUNTRY_GROWTH_COLUMNS = ["Country", "Sales_96", "Profit_96", "Sales_97", "Profit_97", "Sales_98",
                          "Profit_98", "YOY_97", "YOY_98"]


@mart
def country_growth_long(m: Marts) -> DataFrame:
    cr = pct_change(country_transactions(m), ["Country"], "Year", "Annual_Sales", "Sales_YOY")
    return fill_numeric(cr, 0)


@mart
def country_growth(m: Marts) -> DataFrame:
    """G1: full-year country growth, one row per country present in 1998.

    The notebook's ``(1996 right-merge 1997) right-merge 1998`` keeps the
    1998 countries, their 1997 cells when present, and their 1996 cells only
    when the country is also present in 1997; then fills 0."""
    cr = country_growth_long(m)
    p = presence_pivot(cr, ["Country"], "Year", {
        "Sales_96": (1996, "Annual_Sales"), "Profit_96": (1996, "Annual_Profit"),
        "Sales_97": (1997, "Annual_Sales"), "Profit_97": (1997, "Annual_Profit"), "YOY_97": (1997, "Sales_YOY"),
        "Sales_98": (1998, "Annual_Sales"), "Profit_98": (1998, "Annual_Profit"), "YOY_98": (1998, "Sales_YOY"),
    }, {"__in97": 1997, "__in98": 1998})
    p = p.where(F.col("__in98"))
    for c in ("Sales_96", "Profit_96"):
        p = p.withColumn(c, F.when(F.col("__in97"), F.col(c)))
    return fill_numeric(p.select(*COUNTRY_GROWTH_COLUMNS), 0)


@mart
def country_semi_annual(m: Marts) -> DataFrame:
    """The H2 and H1 reshaped tables merged (inner) on their shared columns:
    countries present in 1997-H2 and in 1998-H1."""
    h2 = pct_change(country_transactions_h2(m), ["Country"], "Year", "Annual_Sales", "Sales_YOY")
    h1 = pct_change(country_transactions_h1(m), ["Country"], "Year", "Annual_Sales", "Sales_YOY")
    tagged = (h2.select("Country", F.concat(F.col("Year").cast("string"), F.lit("H2")).alias("__p"),
                        "Annual_Sales", "Annual_Profit", "Sales_YOY")
              .unionByName(h1.select("Country", F.concat(F.col("Year").cast("string"), F.lit("H1")).alias("__p"),
                                     "Annual_Sales", "Annual_Profit", "Sales_YOY")))
    p = presence_pivot(tagged, ["Country"], "__p", {
        "Sales_96_H2": ("1996H2", "Annual_Sales"), "Profit_96_H2": ("1996H2", "Annual_Profit"),
        "Sales_97_H2": ("1997H2", "Annual_Sales"), "Profit_97_H2": ("1997H2", "Annual_Profit"),
        "Sales_YOY_97_H2": ("1997H2", "Sales_YOY"),
        "Sales_97_H1": ("1997H1", "Annual_Sales"), "Profit_97_H1": ("1997H1", "Annual_Profit"),
        "Sales_98_H1": ("1998H1", "Annual_Sales"), "Profit_98_H1": ("1998H1", "Annual_Profit"),
        "Sales_YOY_98_H1": ("1998H1", "Sales_YOY"),
    }, {"__in97h2": "1997H2", "__in98h1": "1998H1"})
    return p.where(F.col("__in97h2") & F.col("__in98h1")).select(
        "Country", "Sales_96_H2", "Profit_96_H2", "Sales_97_H2", "Profit_97_H2", "Sales_YOY_97_H2",
        "Sales_97_H1", "Profit_97_H1", "Sales_98_H1", "Profit_98_H1", "Sales_YOY_98_H1")


@mart
def actual_country_growth(m: Marts, fill_zero: bool = False) -> DataFrame:
    """Like-for-like half-year growth per country. NULLs are kept, as the
    notebook stores them; ``fill_zero=True`` reports them as 0 like the
    full-year table."""
    g = country_semi_annual(m).select("Country", "Sales_YOY_97_H2", "Sales_YOY_98_H1")
    return fill_numeric(g, 0) if fill_zero else g


PRODUCT_GROWTH_COLUMNS = ["Product_ID", "Product_Name", "Category", "N_Sales_96", "N_Sales_97", "N_Sales_98",
                          "N_Profit_96", "N_Profit_98", "N_Profit_97", "YOY_97", "YOY_98"]
PRODUCT_KEYS = ["Product_ID", "Product_Name", "Category"]


@mart
def product_growth(m: Marts) -> DataFrame:
    """Full-year product growth, one row per product sold in 1997
    (``1997 left-merge 1996 left-merge 1998``), NULLs filled with 0."""
    pr = fill_numeric(pct_change(products_report(m), ["Product_ID"], "per_Year", "N_Sales", "Sales_YOY"), 0)
    p = presence_pivot(pr, PRODUCT_KEYS, "per_Year", {
        "N_Sales_96": (1996, "N_Sales"), "N_Profit_96": (1996, "N_Profit"),
        "N_Sales_97": (1997, "N_Sales"), "N_Profit_97": (1997, "N_Profit"), "YOY_97": (1997, "Sales_YOY"),
        "N_Sales_98": (1998, "N_Sales"), "N_Profit_98": (1998, "N_Profit"), "YOY_98": (1998, "Sales_YOY"),
    }, {"__in97": 1997})
    return fill_numeric(p.where(F.col("__in97")).select(*PRODUCT_GROWTH_COLUMNS), 0)


@mart
def actual_product_growth(m: Marts, fill_zero: bool = False) -> DataFrame:
    """Like-for-like half-year growth per product present in 1998-H1
    (``(1996-H2 right-merge 1997-H2) right-merge (1997-H1 right-merge
    1998-H1)``): YOY_97 kept when the product is in 1997-H2; NULLs kept."""
    h2 = pct_change(p_sales_h2(m), ["Product_ID"], "per_Year", "N_Sales", "YOY")
    h1 = pct_change(p_sales_h1(m), ["Product_ID"], "per_Year", "N_Sales", "YOY")
    tagged = (h2.select(*PRODUCT_KEYS, F.concat(F.col("per_Year").cast("string"), F.lit("H2")).alias("__p"), "YOY")
              .unionByName(h1.select(*PRODUCT_KEYS, F.concat(F.col("per_Year").cast("string"), F.lit("H1")).alias("__p"),
                                     "YOY")))
    p = presence_pivot(tagged, PRODUCT_KEYS, "__p", {"YOY_97": ("1997H2", "YOY"), "YOY_98": ("1998H1", "YOY")},
                       {"__in98h1": "1998H1"})
    g = p.where(F.col("__in98h1")).select(*PRODUCT_KEYS, "YOY_97", "YOY_98")
    return fill_numeric(g, 0, subset=["YOY_97", "YOY_98"]) if fill_zero else g


@mart
def growth_comparison(m: Marts) -> DataFrame:
    """Full-year growth next to the aligned half-year growth per country."""
    g1 = country_growth(m).select("Country", "YOY_97", "YOY_98")
    g2 = actual_country_growth(m)
    return natural_merge(g1, g2, "left")


# ---------------------------------------------------------------------------
# Generic growth over the whole data span (no analysis window).

def _net_sales_by(m_full: Marts, entity: str, period_cols) -> DataFrame:
    from ledgerlens.plans.revenue import revenue_transactions
    rt = revenue_transactions(m_full)
    return rt.groupBy(entity, *period_cols).agg(F.sum("Detailed_Net_Sales").alias("Net_Sales"))


def growth_long(m_full: Marts, calendar: bool = False) -> DataFrame:
    """Yearly net-sales growth per country over every year in the data.

    Row semantics by default (the previous row is the base, as ``pct_change``);
    ``calendar=True`` requires the base to be the previous calendar year."""
    base = _net_sales_by(m_full, "Country", [F.year("O_Date").alias("Year")])
    f = calendar_change if calendar else pct_change
    return f(base, ["Country"], "Year", "Net_Sales", "Sales_YOY")


def period_aligned_growth(m_full: Marts, cutoff: tuple[int, int] | None = None) -> DataFrame:
    """Each country's half-year net sales against the same half of the
    previous calendar year, for every year in the data.

    ``cutoff=(month, day)`` keeps only dates up to that day of the year in
    every year (like-for-like when the last period is incomplete)."""
    from ledgerlens.plans.revenue import revenue_transactions
    rt = revenue_transactions(m_full)
    if cutoff is not None:
        mm, dd = cutoff
        md = F.month("O_Date") * 100 + F.dayofmonth("O_Date")
        rt = rt.where(md <= F.lit(mm * 100 + dd))
    half = F.when(F.month("O_Date") <= 6, F.lit("H1")).otherwise(F.lit("H2"))
    base = rt.groupBy("Country", half.alias("Half"), F.year("O_Date").alias("Year")).agg(
        F.sum("Detailed_Net_Sales").alias("Net_Sales"))
    out = calendar_change(base, ["Country", "Half"], "Year", "Net_Sales", "Aligned_YOY")
    return out.select("Country", "Year", "Half", "Net_Sales", "Aligned_YOY")



"""Small queries exercising each generic operator on the sales tables.

Operators that a named mart already exercises in full are mapped to that
mart in ``ledgerlens.catalog``; the ones here show an operator on its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import dates, money, text
from ledgerlens.operators import quality
from ledgerlens.operators.quality import Rules
from ledgerlens.operators.reshape import fill_numeric, natural_merge, slice_rows, union_distinct
from ledgerlens.plans import views
from ledgerlens.plans.context import Marts
from ledgerlens.plans.country import country_transactions
from ledgerlens.plans.growth import (actual_country_growth, actual_product_growth, country_growth,
                                     country_growth_long, product_growth)
from ledgerlens.plans.kpi import sales_pivot_country
from ledgerlens.plans.product import product_dim, product_transactions, products_report
from ledgerlens.plans.revenue import (lines_in, lines_schema, order_lines, order_transactions, revenue_transactions,
                                       store_lines)
from ledgerlens.plans.shipping import shipping_report
from ledgerlens.session import table_root
from ledgerlens.sources.line_store import HALF, new_folder, read_line_store
from ledgerlens.sources.sinks import materialize, publish_table, table_name



def scan_table(m: Marts) -> DataFrame:
    """A1: the whole Products table."""
    return m.t.products


def scan_project(m: Marts) -> DataFrame:
    """A2: a column subset of Orders (only these columns are read)."""
    return m.t.orders.select("OrderID", "OrderDate", "ShippedDate", "ShipVia", "Freight")


def scan_ordered(m: Marts) -> DataFrame:
    """A3: a view read in a stated order."""
    return country_transactions(m).orderBy("Year", "Country")


def load_query(m: Marts, name: str = "Country_Transactions") -> DataFrame:
    """A4: a mart loaded by its view name (lazy; nothing is collected)."""
    return views.view(m, name)


SAVED = "Country_Transactions_Saved"


def save_table_roundtrip(m: Marts) -> DataFrame:
    """A5: a mart written as a new catalog table and read back by its name. A
    second write must fail, as the table exists; ``Second_Write`` says with what."""
    spark = m.spark
    spark.sql(f"DROP TABLE IF EXISTS {table_name(spark, SAVED)}")  # of an earlier run of this query
    rules = Rules(max_len={"Country": 15})
    publish_table(country_transactions(m), SAVED, rules)
    try:
        publish_table(country_transactions(m), SAVED, rules)
        outcome = "written twice"
    except AnalysisException as e:
        outcome = e.getCondition()
    return spark.table(table_name(spark, SAVED)).withColumn("Second_Write", F.lit(outcome))


def stored_slices(m: Marts) -> DataFrame:
    """B7 on stored tables: V1 written by half-year beside a calendar of them, then
    its sales in the half-years that are compared. The calendar's tags choose
    these, and the join prunes the stored half-years at run time."""
    spark = m.spark
    schema = lines_schema(m)
    lines = read_line_store(spark, store_lines(m, new_folder(table_root(spark), "lines")), schema)
    tags = {h: tag for tag, ps in (("H1", dates.H1_SLICES), ("H2", dates.H2_SLICES)) for p in ps for h in p.halves}
    # Every half-year of the orders has a row, a few have a tag.
    tagged = F.coalesce(*[F.when(F.col("code") == h, F.lit(tag)) for h, tag in tags.items()])
    calendar = m.t.orders.select(dates.half_code(F.col("OrderDate")).alias("code")).distinct().withColumn("Tag", tagged)
    slices = materialize(calendar, "calendar")
    # Two rows a year of the calendar: a broadcast of proven size, which the scan reuses.
    j = lines.join(F.broadcast(slices.where("Tag IN ('H1', 'H2')")), F.col(HALF) == F.col("code"))
    return j.groupBy("Tag", F.floor(F.col("code") / 10).cast("int").alias("Year")).agg(
        F.count(F.lit(1)).alias("Lines"), F.sum("Q").alias("Quantity"), F.sum("Detailed_Net_Sales").alias("Net_Sales"))


def union_distinct_slices(m: Marts) -> DataFrame:
    """S3: UNION of two overlapping slices of V1, sliced on their own: 1997 and
    July 1996 to June 1997. Rows that are in both, or twice in one, count once."""
    def branch(*periods) -> DataFrame:
        return lines_in(m, periods).select("P_ID", F.year("O_Date").alias("per_Year"), "Q", "Discount")

    return union_distinct(branch(dates.year_period(1997)), branch(dates.second_half(1996), dates.first_half(1997)))


def freight_share(m: Marts) -> DataFrame:
    """A shipper's part of its year's freight, as a ratio and, as money over
    money is kept in the source, with four decimals."""
    g = shipping_report(m).groupBy("per_Year", "Shipping_Company").agg(F.sum("Freight").alias("Freight"))
    total = F.sum("Freight").over(Window.partitionBy("per_Year"))
    g = g.withColumn("total", total)
    return g.select("per_Year", "Shipping_Company", "Freight", money.ratio(F.col("Freight"), F.col("total")).alias("Share"),
                    money.ratio(F.col("Freight"), F.col("total"), scale=4).alias("Share_4"))


def named_view(m: Marts) -> DataFrame:
    """Marts registered as temporary views and queried with SQL."""
    views.register_views(m, ["Revnue_Transactions", "Country_Transactions", "Shipping_Report"])
    return m.spark.sql("SELECT Country, Country_ID, Year, Annual_Sales, Annual_Profit FROM Country_Transactions")


def project_alias(m: Marts) -> DataFrame:
    """Order dates as DATE, ship date imputed, status from a CASE."""
    o = m.t.orders
    return o.select(
        F.col("OrderID").alias("O_ID"),
        F.col("OrderDate").alias("O_Date"),
        F.col("RequiredDate").alias("Required_Date"),
        dates.impute_date(F.col("ShippedDate"), F.col("OrderDate"), m.impute_days).alias("Shipped_Date"),
        F.when(F.col("ShippedDate").isNull(), "In_Transit").otherwise("Shipped").alias("Shipping_Status"))


def filter_null(m: Marts) -> DataFrame:
    """B2: orders without a ship date, counted per shipper."""
    o = m.t.orders.where(F.col("ShippedDate").isNull())
    return o.groupBy("ShipVia").agg(F.count("OrderID").alias("Orders"), F.sum("Freight").alias("Freight"))


def filter_eq_or(m: Marts) -> DataFrame:
    """``P_ID = 1 OR P_ID = 5``."""
    pt = product_transactions(m)
    return pt.where((F.col("P_ID") == 1) | (F.col("P_ID") == 5))


def filter_like_prefix(m: Marts) -> DataFrame:
    """OR of prefix patterns, case-insensitive."""
    return country_transactions(m).where(text.like_any(F.col("Country"), ("nation_1%", "nation_2%")))


def filter_like_contains(m: Marts) -> DataFrame:
    """Contains-pattern on a lower-case fragment."""
    rt = revenue_transactions(m).where(text.like_any(F.col("Country"), ("%ion_2%",)))
    return rt.groupBy("Country").agg(F.count(F.lit(1)).alias("Lines"),
                                     F.sum("Detailed_Net_Sales").alias("Net_Sales"))


def like_no_wildcard(m: Marts) -> DataFrame:
    """``LIKE 'Shipped'`` is an equality test."""
    ot = order_transactions(m).where(F.col("Shipping_Status").like("Shipped"))
    return ot.groupBy("per_Year").agg(F.count("O_ID").alias("Shipped_Orders"))


def filter_year_month(m: Marts) -> DataFrame:
    """A calendar-half slice as a date range (prunable at the scan)."""
    rt = lines_in(m, (dates.second_half(1997),))
    return rt.groupBy(F.month("O_Date").alias("per_Month")).agg(F.sum("Detailed_Net_Sales").alias("Net_Sales"))


def filter_query_expr(m: Marts) -> DataFrame:
    """A string predicate (``df.query('Year == 1996')``)."""
    return country_transactions(m).filter("Year = 1996")


def case_when(m: Marts) -> DataFrame:
    """Orders per shipping status and on-time flag."""
    s = shipping_report(m)
    return s.groupBy("Shipping_Status", "Delivery_Status").agg(F.count("O_ID").alias("Orders"))


def between_dates_le(m: Marts) -> DataFrame:
    """Orders shipped no later than required, per year."""
    o = order_transactions(m).where(F.col("Shipped_Date") <= F.col("Required_Date"))
    return o.groupBy("per_Year").agg(F.count("O_ID").alias("Orders"))


def select_positions(m: Marts) -> DataFrame:
    """Columns picked by position (0, 3, 4)."""
    ct = country_transactions(m)
    return ct.select(*[ct.columns[i] for i in (0, 3, 4)])


def rename_cols(m: Marts) -> DataFrame:
    """Columns renamed."""
    return country_transactions(m).withColumnsRenamed({"Annual_Sales": "Sales", "Annual_Profit": "Profit"})


def reorder_cols(m: Marts) -> DataFrame:
    """A column moved to the front (``insert(0, name, pop(name))``)."""
    ct = country_transactions(m)
    return ct.select("Year", *[c for c in ct.columns if c != "Year"])


def fill_null_zero(m: Marts) -> DataFrame:
    """The country x year pivot with missing cells as 0."""
    return fill_numeric(sales_pivot_country(m), 0)


def join_left_fact_dim(m: Marts) -> DataFrame:
    """Lines aggregated per product, then joined to the product and
    category dimension, then rolled up per category."""
    rt = revenue_transactions(m)
    per_product = rt.groupBy("P_ID").agg(F.count(F.lit(1)).alias("Lines"),
                                         F.sum("Detailed_Net_Sales").alias("Net_Sales"))
    pdim = product_dim(m).select(F.col("ProductID").alias("P_ID"), "CategoryName")
    j = per_product.join(pdim, "P_ID", "left")
    return j.groupBy(F.col("CategoryName").alias("Category")).agg(F.sum("Lines").alias("Lines"),
                                                                   F.sum("Net_Sales").alias("Net_Sales"))


def join_inner(m: Marts) -> DataFrame:
    """Orders joined (inner) with employees: orders per employee."""
    o = order_transactions(m)
    e = m.t.employees.select("EmployeeID", "LastName")
    j = o.join(e, o["E_ID"] == e["EmployeeID"], "inner")
    return j.groupBy("E_ID", "LastName").agg(F.count("O_ID").alias("Orders"))


def join_natural_right(m: Marts) -> DataFrame:
    """1996 slice right-merged with the 1997 slice of the country table."""
    cr = country_growth_long(m)
    cols = ["Country", "Annual_Sales", "Annual_Profit"]
    a = slice_rows(cr, "Year", 1996, cols, {"Annual_Sales": "Sales_96", "Annual_Profit": "Profit_96"})
    return natural_merge(a, slice_rows(cr, "Year", 1997, cols + ["Sales_YOY"]), "right")


def join_natural_left(m: Marts) -> DataFrame:
    """1997 product slice left-merged with the 1996 slice."""
    pr = products_report(m)
    keys = ["Product_ID", "Product_Name", "Category"]
    a = slice_rows(pr, "per_Year", 1997, keys + ["N_Sales"], {"N_Sales": "N_Sales_97"})
    b = slice_rows(pr, "per_Year", 1996, keys + ["N_Sales"])
    return natural_merge(a, b, "left").withColumnRenamed("N_Sales", "N_Sales_96")


def scalar_functions(m: Marts) -> DataFrame:
    """F1-F12 on the order lines: money rounding, decimals, dates, text."""
    od = m.t.order_details
    o = m.t.orders.select("OrderID", "OrderDate", "ShippedDate", "CustomerID")
    j = od.join(o, "OrderID", "left")
    return j.select(
        F.col("OrderID").alias("O_ID"),
        F.col("ProductID").alias("P_ID"),
        money.net_sales(F.col("UnitPrice"), F.col("Quantity"), F.col("Discount")).alias("N_Sales"),
        money.round_money(F.col("UnitPrice") * F.col("Quantity") * money.dec("0.07")).alias("Expected_Profit"),
        money.cast_decimal(F.col("UnitPrice") * F.col("Discount"), 4).alias("Unit_Discount"),
        F.year("OrderDate").alias("Year"),
        F.month("OrderDate").alias("Month"),
        F.date_add(F.col("OrderDate"), 8).alias("Plus_8"),
        dates.days_between(F.col("OrderDate"), F.col("ShippedDate")).alias("Days"),
        text.concat_strict(F.year("OrderDate").cast("string"), "-", text.left(F.col("ProductID").cast("string"), 2)).alias("Strict_ID"),
        text.concat_lenient(F.col("ShippedDate").cast("string"), "|", F.col("CustomerID").cast("string")).alias("Lenient_ID"),
        (F.col("ExtendedPrice") - F.col("UnitPrice") * F.col("Quantity")).alias("Price_Residual"),
    )


def net_sales_sql_function(m: Marts) -> DataFrame:
    """U: the net-sales rule as a session SQL function, used from SQL."""
    spark = m.spark
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION n_sales(price DECIMAL(18,4), qty INT, disc DECIMAL(9,4)) "
              "RETURNS DECIMAL(18,4) RETURN CAST(ROUND(price * qty * (1 - disc), 2) AS DECIMAL(18,4))")
    m.t.order_details.createOrReplaceTempView("order_details_v")
    return spark.sql("SELECT OrderID AS O_ID, ProductID AS P_ID, n_sales(UnitPrice, Quantity, Discount) AS N_Sales "
                     "FROM order_details_v")


GROWTH_MARTS = {"Country_Growth": country_growth, "Actual_Country_Growth": actual_country_growth,
                "Product_Growth": product_growth, "Actual_Product_Growth": actual_product_growth}


def _reports(m: Marts, report) -> DataFrame:
    parts = [report(fn(m), name, views.GROWTH_RULES[name]) for name, fn in GROWTH_MARTS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def enforce_not_null(m: Marts) -> DataFrame:
    """NULL counts of the columns that the stored growth tables hold as NOT
    NULL (``views.save_growth_tables`` refuses to store them otherwise)."""
    return _reports(m, lambda df, name, rules: quality.null_report(df, name, rules.not_null))


def enforce_type_len(m: Marts) -> DataFrame:
    """INT and NVARCHAR(n) rule violations of the growth tables."""
    return _reports(m, lambda df, name, rules: quality.rule_report(df, name, rules.ints, rules.max_len))


def order_counts_by_year(m: Marts) -> DataFrame:
    """COUNT(col) of non-null values per year."""
    return order_lines(m).groupBy("per_Year").agg(F.count("O_ID").alias("Orders"),
                                                  F.count("C_ID").alias("Orders_with_Customer"))


def distinct_customers_by_year(m: Marts) -> DataFrame:
    """D3: COUNT(DISTINCT) per group."""
    rt = revenue_transactions(m)
    return rt.groupBy(F.year("O_Date").alias("per_Year")).agg(F.countDistinct("C_ID").alias("Customers"))


def sort_multi(m: Marts) -> DataFrame:
    """Multi-key sort of the product report."""
    return products_report(m).orderBy("Product_ID", "per_Year")

"""Product marts: V10-V24.

The chain is: product-year totals (V10) -> product details (V11) -> order
shares of each line (V12, with the fan-out of the source view; V12b without)
-> freight allocation (V13/V13b) -> half-year slices (V14/V15), running
averages (V16), product-year report (V17), discount-rate sums (V18-V21),
half-year product reports (V22/V22b/V23) and category performance (V24).

Lines are read with the columns and periods that a mart needs. Products are
ids until a mart shows them: names are joined to lines or sums at the end, except
in V12 and V13, which show all lines (``named_lines``).
Period totals come from the order totals, not from a further pass over the
lines, through one scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerlens.functions import dates, money
from ledgerlens.functions.text import concat_lenient, concat_strict, left
from ledgerlens.operators.running import running_totals
from ledgerlens.operators.shares import period_lookup, share
from ledgerlens.plans.context import Marts, mart
from ledgerlens.plans.revenue import dated_orders, line_amounts, order_lines, sold_lines, undated_lines
from ledgerlens.sources.line_store import HALF

# Stock classes (fixed values).
RESTOCK, STOPPED, SAFE, NO_RESTOCK = "Restock", "Stopped", "Safe_Stock", "No_Restock"


def stock_status_expr(reorder, stock, discontinued):
    return (F.when((reorder >= stock) & (discontinued == 0), F.lit(RESTOCK))
            .when((reorder >= stock) & (discontinued == 1), F.lit(STOPPED))
            .when((reorder < stock) & (discontinued == 0), F.lit(SAFE))
            .otherwise(F.lit(NO_RESTOCK)))


@mart
def product_dim(m: Marts) -> DataFrame:
    """Products with category and supplier names, at product grain."""
    p = m.t.products
    c = m.t.categories
    s = m.t.suppliers.select("SupplierID", F.col("CompanyName").alias("_SupplierName"))
    return p.join(c, "CategoryID", "left").join(s, "SupplierID", "left")


@mart
def stock_status(m: Marts) -> DataFrame:
    """The four stock classes for every product."""
    p = m.t.products
    return p.select(F.col("ProductID").alias("P_ID"),
                    stock_status_expr(F.col("ReorderLevel"), F.col("UnitsInStock"), F.col("Discontinued"))
                    .alias("Stock_Status"))


@mart
def product_half_rollup(m: Marts, periods: tuple = ()) -> DataFrame:
    """Line measures summed per product and half-year: the one pass over the
    lines behind V10, V11, V18-V21 and V24. ``periods`` limits it to slices."""
    rt = sold_lines(m, periods)
    units = line_amounts(quantity="Q")
    return rt.groupBy("P_ID", F.col(HALF).alias("half")).agg(
        F.sum("Q").alias("Q_Sold"),
        money.sum_units(units["gross"], 4).alias("P_Sales"),
        money.sum_units(units["off"], 2).alias("P_Discount"),
        money.sum_units(units["net"], 2).alias("P_Net_Sales"),
        money.sum_units(units["profit"], 2).alias("P_Net_Profit"),
        money.sum_units(F.col("_rate"), 4).alias("Rates"),
    )


@mart
def product_year_totals(m: Marts) -> DataFrame:
    """Half-years added up to (year, product), before any product join."""
    sums = ("Q_Sold", "P_Sales", "P_Discount", "P_Net_Sales", "P_Net_Profit")
    year = F.floor(F.col("half") / 10).cast("int")
    return product_half_rollup(m).groupBy(year.alias("per_Year"), "P_ID").agg(*[F.sum(c).alias(c) for c in sums])


@mart
def product_year(m: Marts) -> DataFrame:
    """Product-year totals joined once with the product dimension."""
    pd_ = product_dim(m).withColumnRenamed("ProductID", "P_ID")
    return product_year_totals(m).join(pd_, "P_ID", "left")


@mart
def product_transactions(m: Marts) -> DataFrame:
    """Totals per product and year."""
    py = product_year(m)
    year_id = concat_strict(F.col("per_Year").cast("string"), "-", F.col("P_ID").cast("string"))
    return py.select(year_id.alias("Year_ID"), "per_Year", "P_ID",
                     left(F.col("ProductName"), 15).alias("P_Name"),
                     "Q_Sold", "P_Sales", "P_Discount", "P_Net_Sales", "P_Net_Profit")


def product_period_rollup(m: Marts) -> DataFrame:
    """Net sales and quantity per product and year, and per product, year and
    half, in one pass (GROUPING SETS); ``Half`` is NULL on the year's rows."""
    rt = sold_lines(m).select("P_ID", F.year("O_Date").alias("per_Year"), (F.col(HALF) % 10).cast("int").alias("half"), "Q",
                                 line_amounts(quantity="Q")["net"].alias("net"))
    g = rt.groupingSets([["P_ID", "per_Year"], ["P_ID", "per_Year", "half"]], "P_ID", "per_Year", "half").agg(
        F.grouping("half").cast("int").alias("Whole_Year"), F.sum("Q").alias("Q_Sold"), money.sum_units(F.col("net"), 2).alias("P_Net_Sales"))
    return g.select("P_ID", "per_Year", F.col("half").alias("Half"), "Whole_Year", "Q_Sold", "P_Net_Sales")


@mart
def year_divisors(m: Marts) -> DataFrame:
    """Per year: total discount, total net sales, distinct orders (one row per
    year), from the order grain."""
    return order_lines(m).groupBy("per_Year").agg(
        F.sum("O_Discount_Amount").alias("discount"), F.sum("O_Net_Sales").alias("net_sales"), F.count("O_ID").alias("orders"))


PRODUCT_DETAIL_COLUMNS = [
    "per_Year", "Year_ID", "P_ID", "P_Name", "Category_ID", "Category", "SupplierID", "Supplier_Name",
    "Q_Sold", "P_Sales", "P_Discount", "P_Net_Sales", "Discount_WA", "NS_pct", "P_Net_Profit",
    "Average_SP", "Updated_SP", "SP_per_Order", "Diff_SP", "Q_Stock", "Reorder_Level",
    "Discontinued", "Stock_Status",
]


@mart
def product_details(m: Marts) -> DataFrame:
    """Product-year enriched with shares of the year and stock status.

    Each year is divided by its own year's totals, which a scalar subquery
    brings to all columns that need them."""
    py = product_year(m)
    of_year = period_lookup(year_divisors(m), "per_Year")
    year = F.col("per_Year")
    avg_sp = money.ratio(F.col("P_Sales"), F.col("Q_Sold"))
    year_id = concat_strict(year.cast("string"), "-", F.col("P_ID").cast("string"))
    return py.select(
        "per_Year", year_id.alias("Year_ID"), "P_ID",
        left(F.col("ProductName"), 15).alias("P_Name"),
        F.col("CategoryID").alias("Category_ID"),
        left(F.col("CategoryName"), 15).alias("Category"),
        "SupplierID",
        left(F.col("_SupplierName"), 15).alias("Supplier_Name"),
        "Q_Sold", "P_Sales", "P_Discount", "P_Net_Sales",
        money.ratio(F.col("P_Discount"), of_year(year, "discount")).alias("Discount_WA"),
        money.ratio(F.col("P_Net_Sales"), of_year(year, "net_sales")).alias("NS_pct"),
        "P_Net_Profit",
        avg_sp.alias("Average_SP"),
        F.col("UnitPrice").alias("Updated_SP"),
        money.ratio(F.col("P_Net_Sales"), of_year(year, "orders")).alias("SP_per_Order"),
        (F.col("UnitPrice").cast("double") - avg_sp).alias("Diff_SP"),
        F.col("UnitsInStock").alias("Q_Stock"),
        F.col("ReorderLevel").alias("Reorder_Level"),
        "Discontinued",
        stock_status_expr(F.col("ReorderLevel"), F.col("UnitsInStock"), F.col("Discontinued")).alias("Stock_Status"),
    )


@mart
def product_names(m: Marts) -> DataFrame:
    """Display names per product, joined where they are shown and no earlier."""
    return product_dim(m).select(F.col("ProductID").alias("__n_P"), left(F.col("ProductName"), 15).alias("Product_Name"),
                                 left(F.col("CategoryName"), 15).alias("Category"))


def with_names(m: Marts, df: DataFrame, product: str = "Product_ID") -> DataFrame:
    return df.join(product_names(m), F.col(product) == F.col("__n_P"), "left").drop("__n_P")


@mart
def product_fanout(m: Marts) -> DataFrame:
    """Per product its number of product-year rows in V10, the fan-out factor of
    the source's product-only join. A task's lines hold most of its products once
    a year: they are dealt by product and year first, so no table of them is
    built next to the sorted join with the orders."""
    years = sold_lines(m).select("P_ID", F.year("O_Date").alias("per_Year")).repartition("P_ID", "per_Year").distinct()
    return years.groupBy(F.col("P_ID").alias("__f_P")).agg(F.count(F.lit(1)).alias("__w"))


# Line measure -> (share column, order total column, integer amount, its scale).
SHARED = {
    "Q": ("WA_Q", "__t_Q", "Q", None),
    "SP": ("WA_SP", "__t_SP", "_price", 4),
    "Total_Sales": ("WA_Sales", "__t_Sales", "gross", 4),
    "Discount_Amount": ("WA_Discount", "__t_Discount", "off", 2),
    "Detailed_Net_Sales": ("WA_Net_Sales", "__t_Net_Sales", "net", 2),
    "Detailed_Net_Profit": ("WA_Net_Profit", "__t_Net_Profit", "profit", 2),
}


def line_measures() -> dict[str, Column]:
    """The integer amount of each of them."""
    units = line_amounts(quantity="Q") | {"Q": F.col("Q"), "_price": F.col("_price")}
    return {c: units[u] for c, (_, _, u, _) in SHARED.items()}


def summed(c: str, amount: Column, over: WindowSpec | None = None) -> Column:
    """The sum of a measure's integers, in its own type."""
    scale = SHARED[c][3]
    return money.sum_over(amount, over) if scale is None else money.sum_units(amount, scale, over)


WEIGHTED_COLUMNS = [
    "Order_Date", "per_Year", "per_Month", "Order_ID", "Product_ID", "Product_Name", "Category",
    "Q", "WA_Q", "SP", "WA_SP", "Total_Sales", "WA_Sales", "Discount_Amount", "WA_Discount",
    "Discount", "Detailed_Net_Sales", "WA_Net_Sales", "Detailed_Net_Profit", "WA_Net_Profit",
]


# What tells the lines of an order apart: all other measures follow from these.
LINE_KEYS = ["O_ID", "P_ID", "O_Date", "_Freight", "Q", "_price", "_rate"]


@mart
def base_lines(m: Marts, fanout: bool, slices: tuple = ()) -> DataFrame:
    """The lines that V12 shows, with ``__copies``, how many lines of V1 each
    stands for: identical lines of an order collapse in the source's DISTINCT
    (``fanout=True``), and none do in the corrected form."""
    rt = sold_lines(m, slices)
    if fanout:
        # Hardly any line collapses, so the groups are about the lines: dealt
        # anew, they are told apart in a task that holds nothing else.
        return rt.repartition("O_ID", "P_ID").groupBy(*LINE_KEYS).agg(F.count(F.lit(1)).alias("__copies"))
    return rt.select(*LINE_KEYS, F.lit(1).cast("bigint").alias("__copies"))


# Measures whose period totals over the lines shown are asked for.
SHOWN = ("Discount_Amount", "Detailed_Net_Sales")


@mart
def order_totals(m: Marts, fanout: bool, slices: tuple = ()) -> DataFrame:
    """What an order's lines are divided by, one row per order (in the fanned-out
    form, each line counts once per product-year row); and its date and the
    discounts and net sales of the lines shown."""
    lines, times = base_lines(m, fanout, slices), F.col("__copies")
    if fanout:
        lines = lines.join(product_fanout(m), F.col("P_ID") == F.col("__f_P"), "left")
        times = times * F.coalesce(F.col("__w"), F.lit(1))
    units = line_measures()
    return lines.groupBy("O_ID").agg(*[summed(c, units[c] * times).alias(t) for c, (_, t, _, _) in SHARED.items()],
                                     F.max("O_Date").alias("__date"), *[summed(c, units[c]).alias(f"__shown_{c}") for c in SHOWN])


NAMES = ("Product_Name", "Category")


@mart
def named_lines(m: Marts) -> DataFrame:
    """The lines of ``base_lines(fanout=True)`` with their order's totals and their
    products' names. A line is moved twice: by product, where it takes the fan-out
    factor and the names while it is narrow, and by order, where identical ones
    collapse, the order is joined and the totals are summed. A total is a window
    over an order's lines: an aggregate joined back would deal all lines once more.

    A line weighs its product's fan-out factor in the totals. If ``part`` has a
    product n times, its lines are shown n times, but weigh once: with the first
    name; with the others the weight is -1, -2, ..., which counts as 0."""
    stored = bool(m.line_store or m.persist)
    further = F.row_number().over(Window.partitionBy("__n_P").orderBy(*NAMES)) - 1
    lines = sold_lines(m).drop(HALF) if stored else undated_lines(m)
    lines = lines.join(product_fanout(m), F.col("P_ID") == F.col("__f_P"), "left")
    lines = lines.join(product_names(m).withColumn("__further", further), F.col("P_ID") == F.col("__n_P"), "left")
    weight = F.when(F.col("__further") > 0, -F.col("__further")).otherwise(F.coalesce(F.col("__w"), F.lit(1)))
    lines = lines.withColumn("__weight", weight).drop("__f_P", "__w", "__n_P", "__further")
    lines = lines.repartition("O_ID").groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("__copies"))
    if not stored:
        orders = dated_orders(m).repartition("OrderID").groupBy("OrderID", "O_Date", "_Freight").agg(F.count(F.lit(1)).alias("__orders"))
        lines = lines.join(orders, F.col("O_ID") == F.col("OrderID"), "left")
        lines = lines.withColumn("__copies", F.col("__copies") * F.coalesce(F.col("__orders"), F.lit(1)))
    units, times, order = line_measures(), F.col("__copies") * F.greatest(F.col("__weight"), F.lit(0)), Window.partitionBy("O_ID")
    totals = {t: F.when(F.col("O_ID").isNotNull(), summed(c, units[c] * times, order)) for c, (_, t, _, _) in SHARED.items()}
    return lines.select(*LINE_KEYS, "__copies", *NAMES, *[total.alias(t) for t, total in totals.items()])


@mart
def share_lines(m: Marts, fanout: bool, slices: tuple = ()) -> DataFrame:
    """Order lines with their order's totals, products as ids.

    ``fanout=True`` reproduces the source view: every line counts once per
    product-year row in the order totals, and identical lines of one order
    collapse (DISTINCT). ``fanout=False`` is the corrected form. The totals are
    an aggregate joined back, so a hot order is split by AQE instead of landing
    in one window."""
    totals = order_totals(m, fanout, slices).select(F.col("O_ID").alias("__t_O"), *[t for _, t, _, _ in SHARED.values()])
    return with_measures(base_lines(m, fanout, slices).join(totals, F.col("O_ID") == F.col("__t_O"), "left").drop("__t_O"))


def with_measures(lines: DataFrame) -> DataFrame:
    """V12's columns of lines that have their order's totals."""
    units = line_measures()
    return lines.select(
        F.col("O_Date").alias("Order_Date"),
        F.year("O_Date").alias("per_Year"),
        F.month("O_Date").alias("per_Month"),
        F.col("O_ID").alias("Order_ID"),
        F.col("P_ID").alias("Product_ID"),
        "Q", *[money.from_units(units[c], scale).cast(money.MONEY).alias(c) for c, (_, _, _, scale) in SHARED.items() if scale],
        money.from_units(F.col("_rate"), 4).cast(money.RATE).alias("Discount"),
        "_Freight", "__copies", *[t for _, t, _, _ in SHARED.values()],
        # The same as integers, for sums.
        F.col("_rate").alias("__u_Discount"), *[units[c].alias(f"__u_{c}") for c in SHARED],
        *[c for c in NAMES if c in lines.columns],
    )


@mart
def weighted_lines(m: Marts, fanout: bool, slices: tuple = ()) -> DataFrame:
    """Order lines with each measure's share of its order, and product names."""
    if fanout and not slices:
        out = with_measures(named_lines(m))
    else:
        out = with_names(m, share_lines(m, fanout, slices))
    for c, (wa, t, _, _) in SHARED.items():
        out = out.withColumn(wa, share(F.col(c), F.col(t), zero_guard=(wa == "WA_Discount")))
    return m.shared(out, "weighted_lines_fanout" if fanout else "weighted_lines", "Order_ID")


@mart
def weighted_averages(m: Marts) -> DataFrame:
    """Line shares of the order, as the source view computes them."""
    return weighted_lines(m, True).select(*WEIGHTED_COLUMNS)


@mart
def weighted_averages_fixed(m: Marts) -> DataFrame:
    """Line shares that sum to 1 per order; every line kept."""
    return weighted_lines(m, False).select(*WEIGHTED_COLUMNS)


ALLOCATION_COLUMNS = [
    "Year_ID", "Order_Date", "per_Month", "per_Year", "Order_ID", "Product_ID", "Product_Name",
    "Category", "Q", "WA_Q", "SP", "Total_Sales", "Discount_Amount", "Discount",
    "Detailed_Net_Sales", "Detailed_Net_Profit", "Allocated_Freight",
]


def freight_cents() -> Column:
    """A line's part of its order's freight, by quantity, in cents."""
    # round(Freight * Q / order quantity, 2) half up, on integers: Freight in
    # 1e-4 units times Q over (order quantity * 100) gives cents.
    return money.div_half_up(money.to_units(F.col("_Freight"), 4) * F.col("Q"), F.col("__t_Q") * F.lit(100))


def product_year_id() -> Column:
    return concat_strict(F.col("per_Year").cast("string"), "-", F.col("Product_ID").cast("string"), left(F.col("Product_Name"), 2))


def _allocate(w: DataFrame) -> DataFrame:
    return w.select(product_year_id().alias("Year_ID"), *ALLOCATION_COLUMNS[1:-1],
                    money.from_units(freight_cents(), 2).cast(money.MONEY).alias("Allocated_Freight"))


def allocated_lines(m: Marts, fanout: bool, slices: tuple = ()) -> DataFrame:
    """V13 with products as ids, and the freight in cents: what the reports per
    product add up."""
    return share_lines(m, fanout, slices).withColumn("__u_Allocated_Freight", freight_cents())


def scale_of(c: str) -> int:
    return 2 if c == "Allocated_Freight" else SHARED[c][3]


@mart
def allocation(m: Marts) -> DataFrame:
    """Order freight allocated to lines by (fanned-out) quantity share."""
    return _allocate(weighted_lines(m, True))


@mart
def allocation_fixed(m: Marts) -> DataFrame:
    """Allocation by true quantity share (sums to the order freight)."""
    return _allocate(weighted_lines(m, False))


def allocation_slices(m: Marts, periods) -> DataFrame:
    """V13 rows without Discount in the given slices, as a set (UNION)."""
    a = _allocate(weighted_lines(m, True, periods))
    return a.select(*[c for c in ALLOCATION_COLUMNS if c != "Discount"]).distinct()


@mart
def allocation_h2(m: Marts) -> DataFrame:
    """July-December 1996 and 1997."""
    return allocation_slices(m, dates.H2_SLICES)


@mart
def allocation_h1(m: Marts) -> DataFrame:
    """January-June 1997 and 1998."""
    return allocation_slices(m, dates.H1_SLICES)


SUMMARY_AVERAGES = {  # output column -> source column rounded to cents
    "Product_Avg_Price": "SP",
    "Product_Avg_Sales": "Total_Sales",
    "Product_Avg_Discount": "Discount_Amount",
    "Product_Avg_N_Sales": "Detailed_Net_Sales",
    "Product_Avg_N_Profit": "Detailed_Net_Profit",
    "Product_Avg_Freight": "Allocated_Freight",
}


@mart
def allocation_summary(m: Marts, frame: str = "cumulative") -> DataFrame:
    """Per product and year, averages over all its allocation rows up to
    that year (cumulative, as the source's ordered window frame), money
    rounded half up to cents, quantity average truncated to an integer.
    ``frame="year"`` averages each year on its own (the stated intent)."""
    a = allocated_lines(m, True)
    sums = {f"__s_{src}": F.sum(F.col(f"__u_{src}") * 10 ** (4 - scale_of(src))) for src in SUMMARY_AVERAGES.values()}
    counts = {f"__n_{src}": F.count(f"__u_{src}") for src in SUMMARY_AVERAGES.values()}
    pre = a.groupBy("Product_ID", "per_Year").agg(F.sum("Q").alias("__q"), F.count("Q").alias("__nq"),
                                                  *[v.alias(k) for k, v in sums.items()],
                                                  *[v.alias(k) for k, v in counts.items()])
    run = (running_totals(pre, ["Product_ID"], "per_Year", ["__q", "__nq", *sums, *counts])
           if frame == "cumulative" else pre)
    run = with_names(m, run)
    return run.select(
        "per_Year", product_year_id().alias("Year_ID"), "Product_ID", "Product_Name", "Category",
        F.when(F.col("__nq") > 0, F.call_function("div", F.col("__q"), F.col("__nq"))).cast("int").alias("Quantity_SOld"),
        *[money.avg_rounded(F.col(f"__s_{src}"), F.col(f"__n_{src}"), 4, 2).cast(money.MONEY).alias(out)
          for out, src in SUMMARY_AVERAGES.items()],
    )


@mart
def products_report(m: Marts) -> DataFrame:
    """Product-year totals over the (deduplicated) share rows."""
    g = share_lines(m, True).groupBy("per_Year", "Product_ID").agg(
        F.sum("Q").alias("Q_Sold"),
        money.ratio(summed("SP", F.col("__u_SP")), F.count("__u_SP")).alias("Avarage_SP"),
        *[summed(c, F.col(f"__u_{c}")).alias(n) for c, n in (("Discount_Amount", "Discount"), ("Detailed_Net_Sales", "N_Sales"), ("Detailed_Net_Profit", "N_Profit"))])
    year_id = concat_lenient(F.col("per_Year").cast("string"), "-", F.col("Product_ID").cast("string"))
    return with_names(m, g).select(year_id.alias("Year_ID"), "per_Year", "Product_ID", "Product_Name", "Category",
                    "Q_Sold", "Avarage_SP", "Discount", "N_Sales", "N_Profit")


def discount_rates(m: Marts, period) -> DataFrame:
    """Sum of line discount rates per product within one slice."""
    halves = product_half_rollup(m, (period,))
    return halves.groupBy("P_ID", F.floor(F.col("half") / 10).cast("int").alias("per_Year")).agg(F.sum("Rates").alias("Discount_pct"))


@mart
def discount_96(m: Marts) -> DataFrame:
    return discount_rates(m, dates.year_period(1996))


@mart
def discount_97_h1(m: Marts) -> DataFrame:
    return discount_rates(m, dates.first_half(1997))


@mart
def discount_97_h2(m: Marts) -> DataFrame:
    return discount_rates(m, dates.second_half(1997))


@mart
def discount_98(m: Marts) -> DataFrame:
    return discount_rates(m, dates.year_period(1998))


HALF_REPORT_COLUMNS = [
    "Year_ID", "per_Year", "Product_ID", "Product_Name", "Category", "Q_Sold", "Assigned_Orders",
    "SP_Order", "SP", "Total_Sales", "Discount", "Discount_pct", "Discount_WA",
    "Deducted_DIscount_pct", "N_Sales", "NS_pct", "Avg_N_Sales", "Net_Profit", "Freight",
]


def half_year_report(m: Marts, slices, tag: str, divisor_year: dict[int, int] | None = None,
                     fixed_allocation: bool = False) -> DataFrame:
    """Product report over half-year slices (one slice per year).

    Each slice's rows are divided by the totals of slice ``divisor_year[y]``
    (default: its own slice). Discount_pct comes from the discount-rate sums of
    the same slice.
    """
    fanout = not fixed_allocation
    g = allocated_lines(m, fanout, slices).groupBy("per_Year", "Product_ID").agg(
        F.sum("Q").alias("Q_Sold"),
        F.count("Order_ID").alias("Assigned_Orders"),
        summed("SP", F.col("__u_SP")).alias("__sp_sum"), F.count("__u_SP").alias("__sp_n"),
        *[summed(c, F.col(f"__u_{c}")).alias(n) for c, n in (
            ("Total_Sales", "Total_Sales"), ("Discount_Amount", "Discount"), ("Detailed_Net_Sales", "N_Sales"), ("Detailed_Net_Profit", "Net_Profit"))],
        F.count("__u_Detailed_Net_Sales").alias("__ns_n"),
        money.sum_units(F.col("__u_Allocated_Freight"), 2).alias("Freight"),
        # The rates of all lines, also of those that collapsed.
        money.sum_units(F.when(F.col("Product_ID").isNotNull(), F.col("__u_Discount") * F.col("__copies")), 4).alias("Discount_pct"))
    # Period divisors: one row per slice year, from the order totals.
    div = order_totals(m, fanout, slices).groupBy(F.year("__date").alias("per_Year")).agg(
        F.count("O_ID").alias("orders"), F.sum("__shown_Discount_Amount").alias("discount"), F.sum("__shown_Detailed_Net_Sales").alias("net_sales"))
    of_period = period_lookup(div, "per_Year")
    year = F.col("per_Year")
    if divisor_year:
        year = F.coalesce(*[F.when(F.col("per_Year") == k, F.lit(v)) for k, v in divisor_year.items()], year)
    g = with_names(m, g).withColumn("Year_ID", product_year_id())
    return g.select(
        concat_strict(F.col("Year_ID"), tag).alias("Year_ID"),
        "per_Year", "Product_ID", "Product_Name", "Category", "Q_Sold", "Assigned_Orders",
        money.ratio(F.col("N_Sales"), of_period(year, "orders")).alias("SP_Order"),
        money.ratio(F.col("__sp_sum"), F.col("__sp_n")).alias("SP"),
        "Total_Sales", "Discount",
        money.cast_decimal(F.col("Discount_pct"), 2).alias("Discount_pct"),
        money.ratio(F.col("Discount"), of_period(year, "discount")).alias("Discount_WA"),
        money.ratio(F.col("Discount"), F.col("Total_Sales")).alias("Deducted_DIscount_pct"),
        "N_Sales",
        money.ratio(F.col("N_Sales"), of_period(year, "net_sales")).alias("NS_pct"),
        money.ratio(F.col("N_Sales"), F.col("__ns_n")).alias("Avg_N_Sales"),
        "Net_Profit", "Freight",
    )


@mart
def p_sales_h2(m: Marts) -> DataFrame:
    """As the source view, the July-December 1997 branch is divided by
    the 1996 totals."""
    return half_year_report(m, dates.H2_SLICES, "H2", divisor_year={1996: 1996, 1997: 1996})


@mart
def p_sales_h2_fixed(m: Marts) -> DataFrame:
    """Each half divided by its own totals."""
    return half_year_report(m, dates.H2_SLICES, "H2")


@mart
def p_sales_h1(m: Marts) -> DataFrame:
    """January-June 1997 and 1998, own-period divisors."""
    return half_year_report(m, dates.H1_SLICES, "H1")


@mart
def category_performance(m: Marts) -> DataFrame:
    """Category-year totals and the share of the year's net sales."""
    per_product = product_year(m)
    g = per_product.groupBy("per_Year", F.col("CategoryID").alias("Category_ID"), left(F.col("CategoryName"), 15).alias("Category")).agg(
        F.sum("Q_Sold").alias("Category_Q_Sales"),
        F.sum("P_Sales").alias("Category_Sales"),
        F.sum("P_Discount").alias("Category_Discount"),
        F.sum("P_Net_Sales").alias("Category_N_Sales"),
        F.sum("P_Net_Profit").alias("Category_Net_Profit"))
    # A year's net sales, over its categories' rows.
    of_year = F.sum("Category_N_Sales").over(Window.partitionBy("per_Year"))
    return g.select("per_Year", "Category_ID", "Category", "Category_Q_Sales", "Category_Sales",
                    "Category_Discount", "Category_N_Sales", "Category_Net_Profit",
                    money.ratio(F.col("Category_N_Sales"), of_year).alias("NS_pct"))

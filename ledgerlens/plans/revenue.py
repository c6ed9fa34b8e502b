"""Line, order and month marts (V1 revenue lines, V2 order totals, V3 months).

Partitioning note: customers are attached to the order header, which is much
smaller than the lines. V1 joins the lines to it on the order id. V2 needs no
line-level join at all: measures depend on the line alone, so they are summed
by order id first (combined map-side, by hash) and the header joins the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import dates, money
from ledgerlens.plans.context import Marts, mart
from ledgerlens.sources.line_store import HALF, read_line_store, write_line_store

SHIPPED = "Shipped"
IN_TRANSIT = "In_Transit"

REVENUE_COLUMNS = [
    "O_Date", "Required_Date", "Shipped_Date", "O_ID", "C_ID", "Country", "Discount", "E_ID",
    "P_ID", "Q", "SP", "Total_Sales", "Discount_Amount", "Detailed_Net_Sales",
    "Detailed_Net_Profit", "Expected_Profit", "ShipVia", "Shipping_Status",
]


@mart
def order_header(m: Marts) -> DataFrame:
    """Orders with their customer attached (order grain)."""
    o = m.t.orders
    c = m.t.customers.select("CustomerID", F.col("CompanyName").alias("_CompanyName"), "Country")
    return o.join(c, "CustomerID", "left")


#: V1's money columns: the line's integer amount, and its scale.
AMOUNTS = {
    "Total_Sales": ("gross", 4), "Discount_Amount": ("off", 2), "Detailed_Net_Sales": ("net", 2),
    "Detailed_Net_Profit": ("profit", 2), "Expected_Profit": ("expected", 2),
}


def details(m: Marts) -> DataFrame:
    """Order lines with price and discount in units of 10^-4 as well."""
    od = m.t.order_details
    known = {"_price": "UnitPrice", "_rate": "Discount"}
    return od.withColumns({c: money.to_units(F.col(d), 4) for c, d in known.items() if c not in od.columns})


def line_amounts(price: str = "_price", quantity: str = "Quantity", rate: str = "_rate") -> dict[str, Column]:
    """Money of an order line as integers: gross is price times quantity, net the
    rule of ``money.net_sales``."""
    return money.line_units(F.col(price), F.col(quantity), F.col(rate))


def line_money(units: dict[str, Column]) -> dict[str, Column]:
    """V1's money columns of those integers."""
    return {c: money.from_units(units[u], scale).cast(money.MONEY) for c, (u, scale) in AMOUNTS.items()}


def header_columns(m: Marts) -> dict[str, Column]:
    """What V1 and V2 take from the order itself."""
    return {
        "O_Date": F.col("OrderDate"),
        "Required_Date": F.col("RequiredDate"),
        "Shipped_Date": dates.impute_date(F.col("ShippedDate"), F.col("OrderDate"), m.impute_days),
        "C_ID": F.col("CustomerID"),
        "E_ID": F.col("EmployeeID"),
        "ShipVia": F.col("ShipVia"),
        "Shipping_Status": F.when(F.col("ShippedDate").isNull(), F.lit(IN_TRANSIT)).otherwise(F.lit(SHIPPED)),
        "_Freight": F.col("Freight"),
    }


def _joined_lines(m: Marts) -> DataFrame:
    rt = details(m).join(order_header(m), "OrderID", "left")
    columns = header_columns(m) | line_money(line_amounts()) | {
        "O_ID": F.col("OrderID"), "P_ID": F.col("ProductID"), "Q": F.col("Quantity"),
        "SP": F.col("UnitPrice"), "Discount": F.col("Discount"),
    }
    names = [*REVENUE_COLUMNS, "_Freight", "_CompanyName"]
    columns |= {c: F.col(c) for c in ("Country", "_CompanyName", "_price", "_rate")}
    names += ["_price", "_rate"]
    return rt.select(*[columns[c].alias(c) for c in names], dates.half_code(F.col("OrderDate")).alias(HALF))


@mart
def revenue_lines(m: Marts) -> DataFrame:
    """V1 plus internal columns (``_Freight``, ``_CompanyName``, ``_Half``) that
    later marts would otherwise fetch by joining Orders/Customers again, and the
    integers (``_price``, ``_rate``) that sums are taken from."""
    lines = _joined_lines(m)
    if m.line_store:
        return read_line_store(m.spark, m.line_store, lines.schema)
    return m.shared(lines, "revenue_lines", "O_ID")


def lines_schema(m: Marts):
    return _joined_lines(m).schema


def store_lines(m: Marts, folder: str) -> str:
    """Write V1's lines as a table partitioned by half-year (see ``line_store``)."""
    return write_line_store(_joined_lines(m), folder)


def lines_in(m: Marts, periods) -> DataFrame:
    """V1's lines within calendar periods. The half-years are named as well, so
    a stored table reads their folders only."""
    return _within(m, revenue_lines(m), periods)


def _within(m: Marts, rt: DataFrame, periods) -> DataFrame:
    rt = rt.where(dates.in_any(F.col("O_Date"), periods))
    return rt.where(F.col(HALF).isin(sorted({h for p in periods for h in p.halves}))) if m.line_store else rt


@mart
def dated_orders(m: Marts) -> DataFrame:
    """What products need of an order: its date and freight."""
    return m.t.orders.select("OrderID", F.col("OrderDate").alias("O_Date"), F.col("Freight").alias("_Freight"))


@mart
def undated_lines(m: Marts) -> DataFrame:
    """The lines by themselves, before they are joined to ``dated_orders``."""
    return details(m).select(F.col("OrderID").alias("O_ID"), F.col("ProductID").alias("P_ID"), F.col("Quantity").alias("Q"), "_price", "_rate")


@mart
def sold_lines(m: Marts, periods: tuple = ()) -> DataFrame:
    """V1's lines (within calendar periods, if any are given) as far as products
    need them: no customer is joined for these."""
    if m.line_store or m.persist:
        rt = revenue_lines(m)
    else:
        rt = details(m).join(dated_orders(m), "OrderID", "left").withColumnsRenamed({"OrderID": "O_ID", "ProductID": "P_ID", "Quantity": "Q"})
        rt = rt.withColumn(HALF, dates.half_code(F.col("O_Date")))
    rt = rt.select("O_ID", "P_ID", "O_Date", "_Freight", "Q", "_price", "_rate", HALF)
    return _within(m, rt, periods) if periods else rt


@mart
def revenue_transactions(m: Marts) -> DataFrame:
    """V1: one row per order line."""
    return revenue_lines(m).select(*REVENUE_COLUMNS)


LINE_MEASURES = {
    "Q": "Quantity_Sold",
    "Total_Sales": "O_Total_Sales",
    "Discount_Amount": "O_Discount_Amount",
    "Detailed_Net_Sales": "O_Net_Sales",
    "Detailed_Net_Profit": "O_Net_Profit",
}


@mart
def order_rollup(m: Marts) -> DataFrame:
    """Order grain with internal columns. The source groups the joined lines by
    the order id and ten order attributes; the attributes come from the order's
    own row, so summing the lines by order id and joining the orders to the
    sums gives the same rows, hashes one number and sorts nothing."""
    units = line_amounts()
    sums = details(m).groupBy("OrderID").agg(F.sum("Quantity").alias(LINE_MEASURES["Q"]), *[
        money.sum_units(units[u], scale).alias(LINE_MEASURES[c]) for c, (u, scale) in AMOUNTS.items() if c in LINE_MEASURES])
    joined = sums.join(m.t.orders, "OrderID", "left")
    return m.shared(joined.select(F.col("OrderID").alias("O_ID"), *[c.alias(n) for n, c in header_columns(m).items()],
                                  *LINE_MEASURES.values()), "order_rollup", "O_ID")


ORDER_COLUMNS = [
    "per_Year", "per_Month", "O_Date", "Required_Date", "Shipped_Date", "Days_to_Ship", "O_ID",
    "C_ID", "E_ID", "Quantity_Sold", "O_Total_Sales", "O_Discount_Amount", "O_Net_Sales",
    "O_Net_Profit", "Freight", "Shipping_Status", "ShipVia",
]


@mart
def order_lines(m: Marts) -> DataFrame:
    """V2's columns."""
    return order_rollup(m).select(
        F.year("O_Date").alias("per_Year"),
        F.month("O_Date").alias("per_Month"),
        "O_Date", "Required_Date", "Shipped_Date",
        money.cast_decimal(dates.days_between(F.col("O_Date"), F.col("Shipped_Date")), 2).alias("Days_to_Ship"),
        "O_ID", "C_ID", "E_ID", *LINE_MEASURES.values(),
        F.col("_Freight").alias("Freight"),
        "Shipping_Status", "ShipVia",
    )


@mart
def customer_orders(m: Marts) -> DataFrame:
    """V2's columns with the customer's ``Country`` and ``_CompanyName``."""
    c = m.t.customers.select(F.col("CustomerID").alias("__c_ID"), F.col("CompanyName").alias("_CompanyName"), "Country")
    return order_lines(m).join(c, F.col("C_ID") == F.col("__c_ID"), "left").drop("__c_ID")


@mart
def order_transactions(m: Marts) -> DataFrame:
    """V2: one row per order."""
    return order_lines(m).select(*ORDER_COLUMNS)


@mart
def monthly_transactions(m: Marts) -> DataFrame:
    """V3: month totals; ``Monthly_Orders`` counts distinct orders, taken as
    the count of order-grain rows (no distinct-aggregate expansion)."""
    o = order_lines(m)
    g = o.groupBy("per_Year", "per_Month").agg(
        F.count("O_ID").alias("Monthly_Orders"),
        F.sum("Quantity_Sold").alias("Monthly_Quantity"),
        F.sum("O_Total_Sales").alias("Monthly_Sales"),
        F.sum("O_Discount_Amount").alias("Monthly_Discount"),
        F.sum("O_Net_Sales").alias("Monthly_Net_Sales"),
        F.sum("O_Net_Profit").alias("Monthly_Net_Profit"),
    )
    date_id = F.concat(F.col("per_Year").cast("string"), F.lit("-"), F.col("per_Month").cast("string"))
    return g.select(date_id.alias("Date_ID"), "per_Month", "per_Year", "Monthly_Orders",
                    "Monthly_Quantity", "Monthly_Sales", "Monthly_Discount",
                    "Monthly_Net_Sales", "Monthly_Net_Profit")

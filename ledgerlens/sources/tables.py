"""The logical sales tables, read from the provided parquet files.

The marts are written against eight logical tables (orders, order details,
customers, products, categories, suppliers, employees, shippers). This module
derives them from the TPC-H-style parquet tables with plain projections, so
every scan keeps column pruning and filter pushdown. Expressions here must stay
identical to the DuckDB twin in ``oracle/sql.py``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ledgerlens.functions import money

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# The employee roster (EmployeeID, TitleOfCourtesy, FirstName,
# LastName, Title, Country, ReportsTo). One manager, two supervisors, six staff.
EMPLOYEE_ROWS = [
    (1, "Ms.", "Alma", "Reyes", "President", "USA", None),
    (2, "Mr.", "Bruno", "Keller", "Sales Manager", "UK", 1),
    (3, "Dr.", "Chioma", "Obi", "Sales Manager", "USA", 1),
    (4, "Mrs.", "Dana", "Novak", "Sales Representative", "UK", 2),
    (5, "Mr.", "Emil", "Lund", "Sales Representative", "UK", 2),
    (6, None, "Farah", "Haddad", "Sales Representative", "USA", 2),
    (7, "Ms.", "Greta", "Moreau", "Sales Representative", "USA", 3),
    (8, "Mr.", "Hiro", "Tanaka", "Inside Sales Coordinator", "USA", 3),
    (9, "Ms.", "Ines", "Silva", "Sales Representative", "UK", 3),
]

# The shipping companies (ShipperID, CompanyName).
SHIPPER_ROWS = [
    (1, "Atlas Freight"),
    (2, "Bluewave Cargo"),
    (3, "Comet Logistics"),
]

EMPLOYEE_SCHEMA = StructType([
    StructField("EmployeeID", IntegerType(), False),
    StructField("TitleOfCourtesy", StringType(), True),
    StructField("FirstName", StringType(), True),
    StructField("LastName", StringType(), True),
    StructField("Title", StringType(), True),
    StructField("Country", StringType(), True),
    StructField("ReportsTo", IntegerType(), True),
])

SHIPPER_SCHEMA = StructType([
    StructField("ShipperID", IntegerType(), False),
    StructField("CompanyName", StringType(), True),
])


class SalesTables:
    """The logical base tables the marts read.

    Tables are given directly (``SalesTables(orders=df, ...)``, e.g. hand-made
    fixtures) or produced on first access by ``loader(name)``, so a query only
    reads the source files it needs.
    """

    NAMES = ("orders", "order_details", "customers", "products", "categories", "suppliers",
             "employees", "shippers")

    # orders:        OrderID, CustomerID, EmployeeID, OrderDate, RequiredDate, ShippedDate, ShipVia, Freight
    # order_details: OrderID, ProductID, Quantity, UnitPrice, Discount, ExtendedPrice
    #                (and, if known, price and discount in units of 10^-4: _price, _rate)
    # customers:     CustomerID, CompanyName, Country
    # products:      ProductID, ProductName, CategoryID, SupplierID, UnitPrice, UnitsInStock, ReorderLevel, Discontinued
    # categories:    CategoryID, CategoryName
    # suppliers:     SupplierID, CompanyName
    # employees:     EmployeeID, TitleOfCourtesy, FirstName, LastName, Title, Country, ReportsTo
    # shippers:      ShipperID, CompanyName

    def __init__(self, loader=None, **frames: DataFrame):
        unknown = set(frames) - set(self.NAMES)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        self._loader = loader
        self._frames = dict(frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SalesTables.NAMES:
            frames = self.__dict__["_frames"]
            if name not in frames:
                loader = self.__dict__["_loader"]
                if loader is None:
                    raise AttributeError(f"table {name!r} was not provided")
                frames[name] = loader(name)
            return frames[name]
        raise AttributeError(name)

    def with_(self, **changes: DataFrame) -> "SalesTables":
        merged = {n: getattr(self, n) for n in self.NAMES if n in self._frames or self._loader}
        merged.update(changes)
        return SalesTables(**merged)


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def employees_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EMPLOYEE_ROWS, EMPLOYEE_SCHEMA)


def shippers_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHIPPER_ROWS, SHIPPER_SCHEMA)


def orders_from_raw(raw_orders: DataFrame, window=None) -> DataFrame:
    o = raw_orders
    if window is not None:
        lo, hi = window
        # On the raw timestamp column, so it reaches the parquet reader.
        o = o.filter((F.col("o_orderdate") >= F.lit(dt.datetime.combine(lo, dt.time())))
                     & (F.col("o_orderdate") < F.lit(dt.datetime.combine(hi, dt.time()))))
    order_date = F.col("o_orderdate").cast("date")
    lead_days = F.when(F.col("o_orderpriority") == "1-URGENT", 14).otherwise(28)
    ship_days = ((F.col("o_orderkey") * 7) % 36 + 1).cast("int")
    return o.select(
        F.col("o_orderkey").alias("OrderID"),
        F.col("o_custkey").alias("CustomerID"),
        (F.col("o_orderkey") % 9 + 1).cast("int").alias("EmployeeID"),
        order_date.alias("OrderDate"),
        F.date_add(order_date, lead_days).alias("RequiredDate"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("date"))
         .otherwise(F.date_add(order_date, ship_days)).alias("ShippedDate"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("ShipVia"),
        money.round_money(F.col("o_totalprice").cast(money.MONEY) * money.dec("0.02")).alias("Freight"),
    )


def details_from_raw(raw_lines: DataFrame) -> DataFrame:
    """Order lines. The source's prices and rates are floating point numbers of
    few decimals: they become integers of 10^-4 at once (``_price``, ``_rate``),
    and decimals only where a decimal column is read."""
    qty = F.col("l_quantity").cast("int")
    units = raw_lines.select(
        F.col("l_orderkey").alias("OrderID"),
        F.col("l_partkey").alias("ProductID"),
        qty.alias("Quantity"),
        _ten_thousandths("l_extendedprice").alias("_gross"),
        _ten_thousandths("l_discount").alias("_rate"),
    )
    priced = units.withColumn("_price", money.div_half_up(F.col("_gross"), F.col("Quantity")))
    return priced.select(
        "OrderID", "ProductID", "Quantity",
        money.from_units(F.col("_price"), 4).alias("UnitPrice"),
        money.from_units(F.col("_rate"), 4).cast(money.RATE).alias("Discount"),
        money.from_units(F.col("_gross"), 4).alias("ExtendedPrice"),
        "_price", "_rate",
    )


def _ten_thousandths(name: str):
    """A number as the nearest integer of 10^-4."""
    return F.floor(F.col(name).cast("double") * 10_000 + 0.5)


def categories_from_raw(raw_part: DataFrame) -> DataFrame:
    # The distinct part types are a small fixed domain, so numbering them in
    # one ordered window only ever sees that handful of rows.
    types = raw_part.select(F.col("p_type").alias("CategoryName")).where("CategoryName IS NOT NULL").distinct()
    return types.select(
        F.row_number().over(Window.orderBy("CategoryName")).cast("int").alias("CategoryID"),
        "CategoryName")


def products_from_raw(raw_part: DataFrame, categories: DataFrame) -> DataFrame:
    p = raw_part.join(categories, raw_part["p_type"] == categories["CategoryName"], "left")
    return p.select(
        F.col("p_partkey").alias("ProductID"),
        F.col("p_name").alias("ProductName"),
        F.col("CategoryID"),
        (F.col("p_partkey") % 10).cast("bigint").alias("SupplierID"),
        F.col("p_retailprice").cast(money.MONEY).alias("UnitPrice"),
        ((F.col("p_partkey") * 13) % 126).cast("int").alias("UnitsInStock"),
        (F.col("p_size") % 31).cast("int").alias("ReorderLevel"),
        F.when(F.col("p_partkey") % 10 == 0, 1).otherwise(0).alias("Discontinued"),
    )


def customers_from_raw(raw_customer: DataFrame, raw_nation: DataFrame) -> DataFrame:
    n = raw_nation.select("n_nationkey", "n_name")
    c = raw_customer.join(n, raw_customer["c_nationkey"] == n["n_nationkey"], "left")
    return c.select(
        F.col("c_custkey").alias("CustomerID"),
        F.col("c_name").alias("CompanyName"),
        F.col("n_name").alias("Country"),
    )


def suppliers_from_raw(raw_supplier: DataFrame) -> DataFrame:
    return raw_supplier.select(F.col("s_suppkey").alias("SupplierID"),
                               F.col("s_name").alias("CompanyName"))


def load_sales_tables(spark: SparkSession, sf_dir: str, window=None) -> SalesTables:
    """Logical tables over ``sf_dir``, each built on first use. All orders and
    lines, unless a (first day, day after the last) window is asked for."""
    raw_cache: dict[str, DataFrame] = {}
    built: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        if name not in raw_cache:
            raw_cache[name] = read_raw(spark, sf_dir, name)
        return raw_cache[name]

    def categories() -> DataFrame:
        if "categories" not in built:
            built["categories"] = categories_from_raw(raw("part"))
        return built["categories"]

    def orders() -> DataFrame:
        if "orders" not in built:
            built["orders"] = orders_from_raw(raw("orders"), window)
        return built["orders"]

    def load(name: str) -> DataFrame:
        if name == "orders":
            return orders()
        if name == "order_details":
            lines = raw("lineitem")
            if window is not None:
                keys = orders().select(F.col("OrderID").alias("l_orderkey"))
                lines = lines.join(keys, "l_orderkey", "left_semi")
            return details_from_raw(lines)
        if name == "customers":
            return customers_from_raw(raw("customer"), raw("nation"))
        if name == "products":
            return products_from_raw(raw("part"), categories())
        if name == "categories":
            return categories()
        if name == "suppliers":
            return suppliers_from_raw(raw("supplier"))
        if name == "employees":
            return employees_df(spark)
        if name == "shippers":
            return shippers_df(spark)
        raise KeyError(name)

    return SalesTables(loader=load)


__all__ = [
    "SalesTables", "load_sales_tables", "read_raw", "employees_df",
    "shippers_df",
]

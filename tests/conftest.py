from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql.types import (DateType, DecimalType, IntegerType, LongType, StringType,  # noqa: E402
                               StructField, StructType)

from ledgerlens.plans.context import Marts  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402
from ledgerlens.sources.tables import SalesTables, employees_df, shippers_df  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="ledgerlens-tests", shuffle_partitions=8)
    yield s
    s.stop()


D = dt.date
M = Decimal

ORDERS = StructType([
    StructField("OrderID", LongType()), StructField("CustomerID", LongType()),
    StructField("EmployeeID", IntegerType()), StructField("OrderDate", DateType()),
    StructField("RequiredDate", DateType()), StructField("ShippedDate", DateType()),
    StructField("ShipVia", IntegerType()), StructField("Freight", DecimalType(18, 4)),
])
DETAILS = StructType([
    StructField("OrderID", LongType()), StructField("ProductID", LongType()),
    StructField("Quantity", IntegerType()), StructField("UnitPrice", DecimalType(18, 4)),
    StructField("Discount", DecimalType(9, 4)), StructField("ExtendedPrice", DecimalType(18, 4)),
])
CUSTOMERS = StructType([StructField("CustomerID", LongType()), StructField("CompanyName", StringType()),
                        StructField("Country", StringType())])
PRODUCTS = StructType([
    StructField("ProductID", LongType()), StructField("ProductName", StringType()),
    StructField("CategoryID", IntegerType()), StructField("SupplierID", LongType()),
    StructField("UnitPrice", DecimalType(18, 4)), StructField("UnitsInStock", IntegerType()),
    StructField("ReorderLevel", IntegerType()), StructField("Discontinued", IntegerType()),
])
CATEGORIES = StructType([StructField("CategoryID", IntegerType()), StructField("CategoryName", StringType())])
SUPPLIERS = StructType([StructField("SupplierID", LongType()), StructField("CompanyName", StringType())])


def order(oid, cust=1, emp=4, date=D(1997, 3, 3), required=None, shipped="auto", via=1, freight="10.00"):
    required = required or date + dt.timedelta(days=28)
    if shipped == "auto":
        shipped = date + dt.timedelta(days=5)
    return (oid, cust, emp, date, required, shipped, via, None if freight is None else M(freight))


def line(oid, pid, qty, price, disc="0"):
    price = M(price)
    return (oid, pid, qty, price, M(disc), price * qty)


def make_marts(spark, orders, details, customers=None, products=None, categories=None, suppliers=None,
               **kw) -> Marts:
    customers = customers or [(1, "Alpha Foods", "Norway"), (2, "Beta Traders", "Poland"),
                              (3, "Gamma Stores", "Denmark")]
    pids = sorted({d[1] for d in details if d[1] is not None}) or [1]
    products = products or [(p, f"Product {p}", 1, 1, M("20"), 50, 10, 0) for p in pids]
    categories = categories or [(1, "Beverages"), (2, "Condiments")]
    suppliers = suppliers or [(1, "Supplier One")]
    tables = SalesTables(
        orders=spark.createDataFrame(orders, ORDERS),
        order_details=spark.createDataFrame(details, DETAILS),
        customers=spark.createDataFrame(customers, CUSTOMERS),
        products=spark.createDataFrame(products, PRODUCTS),
        categories=spark.createDataFrame(categories, CATEGORIES),
        suppliers=spark.createDataFrame(suppliers, SUPPLIERS),
        employees=employees_df(spark),
        shippers=shippers_df(spark),
    )
    return Marts(tables, persist=False, **kw)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]

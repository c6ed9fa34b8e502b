"""Employee marts: V25 employee-year totals with position, V26 employee-month
performance by shipping status (and its tidy one-row-per-month variant)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import concat_strict, full_name
from ledgerlens.plans.context import Marts, mart
from ledgerlens.plans.revenue import IN_TRANSIT, SHIPPED, order_lines

MANAGER, SUPERVISOR, EMPLOYEE = "Manager", "Supervisor", "Employee"


@mart
def employee_dim(m: Marts) -> DataFrame:
    """Employees with Full_Name and Position. Position asks whether the employee
    id is IN the column of ReportsTo values, which Spark plans as an existence
    join. That column has a null (the top manager's own), so for ids that are
    not in it the answer is unknown, not false: they fall to the last case."""
    e = m.t.employees
    position = (F.when(F.col("ReportsTo").isNull(), F.lit(MANAGER))
                .when(F.col("EmployeeID").isin(e.select("ReportsTo")), F.lit(SUPERVISOR))
                .otherwise(F.lit(EMPLOYEE)))
    return e.select("EmployeeID", "FirstName", "Title", "ReportsTo", F.col("Country").alias("E_Country"),
                    full_name(F.col("TitleOfCourtesy"), F.col("FirstName"), F.col("LastName")).alias("Full_Name"),
                    position.alias("Position"))


@mart
def employee_transactions(m: Marts) -> DataFrame:
    """Per employee and year. Distinct orders are counted as order-grain
    rows (each order has one employee and one date)."""
    o = order_lines(m)
    g = o.groupBy("per_Year", "E_ID").agg(
        F.count("O_ID").alias("Orders_Made"),
        F.sum("Quantity_Sold").alias("Q_Sold"),
        F.sum("O_Total_Sales").alias("Sales_Acheived"),
        F.sum("O_Discount_Amount").alias("Discount_Made"),
        F.sum("O_Net_Sales").alias("Net_Sales_Achieved"),
        F.sum("O_Net_Profit").alias("Net_Profit_Achieved"))
    e = employee_dim(m)
    j = g.join(e, g["E_ID"] == e["EmployeeID"], "left")
    # An order whose employee is missing has no ReportsTo, hence "Manager".
    position = F.when(F.col("EmployeeID").isNull(), F.lit(MANAGER)).otherwise(F.col("Position"))
    name = F.coalesce(F.col("Full_Name"), F.lit(" . "))
    year_id = concat_strict(F.col("per_Year").cast("string"), "-", F.col("E_ID").cast("string"), "E")
    return j.select(year_id.alias("Year_ID"), "per_Year", F.col("E_ID").alias("Emp_ID"),
                    name.alias("Full_Name"), "E_Country", "ReportsTo", "Orders_Made", "Q_Sold",
                    "Sales_Acheived", "Discount_Made", "Net_Sales_Achieved", "Net_Profit_Achieved",
                    position.alias("Position"))


def _employee_month(m: Marts, by_status: bool) -> DataFrame:
    o = order_lines(m)
    keys = ["per_Year", "per_Month", "E_ID"] + (["Shipping_Status"] if by_status else [])
    aggs = [F.count("O_ID").alias("Orders_Made"),
            F.sum("O_Total_Sales").alias("Sales_Acheived"),
            F.sum("O_Discount_Amount").alias("Discount_Made"),
            F.sum("O_Net_Sales").alias("Net_Sales_Achieved"),
            F.sum("O_Net_Profit").alias("Net_Profit_Achieved")]
    if by_status:
        aggs.append(F.count("Shipping_Status").alias("_n_status"))
    else:
        aggs += [F.count_if(F.col("Shipping_Status") == SHIPPED).alias("Delivered_Orders"),
                 F.count_if(F.col("Shipping_Status") == IN_TRANSIT).alias("Delayed_Orders")]
    g = o.groupBy(*keys).agg(*aggs)
    e = employee_dim(m)
    j = g.join(e, g["E_ID"] == e["EmployeeID"], "inner")
    year_id = concat_strict(F.col("per_Year").cast("string"), F.col("per_Month").cast("string"), "-",
                            F.col("E_ID").cast("string"), "E")
    cols = [year_id.alias("Year_ID"), "per_Year", "per_Month", "E_ID", "Full_Name", "Orders_Made",
            "Sales_Acheived", "Discount_Made", "Net_Sales_Achieved", "Net_Profit_Achieved"]
    if by_status:
        cols += [F.when(F.col("Shipping_Status") == SHIPPED, F.col("_n_status")).alias("Delivered_Orders"),
                 F.when(F.col("Shipping_Status").like("%Transi%"), F.col("_n_status")).alias("Delayed_Orders")]
    else:
        cols += ["Delivered_Orders", "Delayed_Orders"]
    return j.select(*cols)


@mart
def employee_performance(m: Marts) -> DataFrame:
    """One row per employee, month and shipping status; the count of the
    other status is NULL on each row (as in the source view)."""
    return _employee_month(m, by_status=True)


@mart
def employee_performance_wide(m: Marts) -> DataFrame:
    """V26 tidy form: one row per employee-month, both counts filled."""
    return _employee_month(m, by_status=False)

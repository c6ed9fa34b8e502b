"""Views and pivots take all orders of their years."""

from __future__ import annotations

import datetime as dt

from conftest import line, make_marts, order, rows

from ledgerlens.plans import kpi, product

D = dt.date


def test_single_year_discounts_take_the_whole_year(spark):
    dates = [D(1995, 12, 31), D(1996, 2, 1), D(1996, 8, 1), D(1998, 3, 1), D(1998, 11, 1), D(1999, 1, 1)]
    m = make_marts(spark, [order(i, date=d) for i, d in enumerate(dates, 1)], [line(i, 7, 1, "10", f"0.0{i}") for i in range(1, 7)])
    for view, year, pct in ((product.discount_96, 1996, 0.05), (product.discount_98, 1998, 0.09)):
        assert [(p, y, float(x)) for p, y, x in rows(view(m), "P_ID", "per_Year", "Discount_pct")] == [(7, year, pct)]


def test_pivots_have_years_beyond_the_given_ones(spark):
    m = make_marts(spark, [order(1, date=D(1997, 3, 3)), order(2, date=D(2003, 3, 3)), order(3, date=D(1990, 3, 3))],
                   [line(1, 7, 1, "10"), line(2, 7, 2, "10"), line(3, 7, 3, "10")])
    for pivot in (kpi.sales_pivot_country, kpi.sales_pivot_category):
        found = pivot(m)
        assert found.columns[1:] == [f"Sales_{y}" for y in (1990, *range(1995, 2002), 2003)]
        row = found.first()
        assert [float(row[f"Sales_{y}"]) for y in (1990, 1997, 2003)] == [30, 10, 20] and row.Sales_2001 is None

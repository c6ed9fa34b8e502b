"""V12 and V13 move a line by product and by order and no further, and show what
joining names and totals to the distinct lines would."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from conftest import D, line, make_marts, order

from ledgerlens.operators.shares import share
from ledgerlens.plans import product, revenue
from ledgerlens.plans.context import Marts

ORDERS = [order(1), order(1), order(1, date=D(1998, 1, 2)), order(2, freight="0.07"), order(3, date=D(1996, 8, 1), freight=None), order(None),
          (6, 1, 4, None, None, None, 1, Decimal("3.0000"))]
LINES = [line(1, 1, 2, "10"), line(1, 1, 2, "10"), line(1, 1, 2, "10", "0.1"), line(1, 2, 5, "3"), line(1, None, 3, "5", "0.1"),
         line(2, 1, 1, "4"), line(2, 2, 2, "4"), line(2, 3, 2, "4"), line(3, 1, 1, "4"), line(3, 9, 7, "1"), line(3, 9, 7, "1"),
         line(None, 2, 1, "1"), line(None, 2, 1, "1"), line(5, 2, 4, "2"), line(6, 2, 4, "2"), line(6, 2, -4, "2"),
         (2, 2, None, Decimal("8.0000"), Decimal("0"), None)]
#: Product 2 comes three times, twice with one name; product 9 is not known.
PRODUCTS = [(p, name, 1, 1, Decimal("20"), 50, 10, 0) for p, name in ((1, "Ale"), (2, "Brie"), (2, "Brie"), (2, "Bun"), (3, None), (None, "none"))]


@pytest.fixture(scope="module")
def m(spark):
    return make_marts(spark, ORDERS, LINES, products=PRODUCTS)


def expected():
    """Rows of (order, product, name, date, quantity, price, discount, order's
    quantity, order's prices) from the joined lines, in plain Python."""
    dates = defaultdict(list)
    for o in ORDERS:
        if o[0] is not None:
            dates[o[0]].append((o[3], o[7]))
    joined = [(x[0], x[1], d, f, x[2], x[3], x[4]) for x in LINES for d, f in dates.get(x[0], [(None, None)])]
    years = defaultdict(set)
    for _, p, d, *_ in joined:
        years[p].add(d and d.year)
    quantity, prices = Counter(), Counter()
    for o, p, _, _, q, price, _ in joined:
        w = 1 if p is None else len(years[p])
        quantity[o] += w * (q or 0)
        prices[o] += w * price
    names = defaultdict(list)
    for p in PRODUCTS:
        names[p[0]].append(p[1])
    return [(o, p, name, d, q, float(price), float(rate), None if o is None else quantity[o], None if o is None else float(prices[o]))
            for o, p, d, _, q, price, rate in set(joined) for name in (names.get(p, [None]) if p is not None else [None])]


def ratio(a, b):
    return None if a is None or not b else round(a / b, 9) + 0.0


def test_rows_are_those_of_the_joined_lines(m):
    got = [(r.Order_ID, r.Product_ID, r.Product_Name, r.Order_Date, r.Q, float(r.SP), float(r.Discount),
            ratio(r.WA_Q, 1), ratio(r.WA_SP, 1)) for r in product.weighted_averages(m).collect()]
    assert Counter(got) == Counter((*x[:7], ratio(x[4], x[7]), ratio(x[5], x[8])) for x in expected())


def test_freight_is_that_of_totals_joined_back(m):
    """The steps that the other marts take to the same lines."""
    joined = product.with_names(m, product.share_lines(m, True))
    got, want = product.allocation(m), product._allocate(joined.withColumn("WA_Q", share(joined["Q"], joined["__t_Q"])))
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert {r.Allocated_Freight is None for r in got.collect()} == {True, False}


@pytest.mark.parametrize("mart", [product.weighted_averages, product.allocation])
def test_lines_are_moved_by_product_and_order_only(spark, mart):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mart(Marts.load(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_extendedprice", plan)) == 1
    assert "hashpartitioning(Product_ID" not in plan


@pytest.mark.parametrize("kw", [{"persist": "memory"}, {"store": True}])
def test_stored_lines_give_the_same_rows(spark, m, kw, tmp_path):
    if kw.pop("store", False):
        kw["line_store"] = revenue.store_lines(m, f"{tmp_path}/lines")
    other = Marts(m.t, **kw)
    try:
        for mart in (product.weighted_averages, product.allocation):
            assert mart(other).exceptAll(mart(m)).isEmpty() and mart(m).exceptAll(mart(other)).isEmpty()
    finally:
        other.release()

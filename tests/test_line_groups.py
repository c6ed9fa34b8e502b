"""Lines of an order are told apart in tasks that hold no join's sorted tables
beside, and order totals need no table of (order, product) pairs."""

from __future__ import annotations

import re

import pytest
from conftest import line, make_marts, order

from ledgerlens.plans import growth, kpi, product


@pytest.fixture(scope="module")
def m(spark):
    orders = [order(1), order(1), order(2, freight="0.07")]
    lines = [line(1, 1, 2, "10"), line(1, 1, 2, "10"), line(1, None, 3, "5", "0.1"), line(2, 1, 1, "4"), line(2, 2, 2, "4"), line(None, 2, 1, "1")]
    return make_marts(spark, orders, lines)


MARTS = [product.weighted_averages, product.allocation, product.allocation_summary, product.products_report, growth.product_growth, kpi.top_category]


@pytest.mark.parametrize("mart", MARTS)
def test_no_join_beside_the_lines_told_apart(m, mart):
    plan = mart(m)._jdf.queryExecution().executedPlan().toString().split("\n")
    groups = [i for i, x in enumerate(plan) if re.search(r"Aggregate\(keys=\[[^\]]*_rate#", x)]
    assert groups
    for i in groups:
        below = next(x for x in plan[i:] if "Exchange" in x or "Join" in x)
        assert "Exchange" in below, below


@pytest.mark.parametrize("mart", MARTS)
def test_no_pairs_of_order_and_product(m, mart):
    plan = mart(m)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys=\[O_ID#\d+L?, P_ID#\d+L?\]", plan)


def test_repeated_orders_and_lines_and_missing_keys(m):
    """Every line of the join counts in the totals, each distinct one is shown."""
    got = {(r.Order_ID, r.Product_ID): (r.Q, r.WA_Q) for r in product.weighted_averages(m).collect()}
    assert got == {(1, 1): (2, 2 / 14), (1, None): (3, 3 / 14), (2, 1): (1, 1 / 5), (2, 2): (2, 2 / 5), (None, 2): (1, None)}

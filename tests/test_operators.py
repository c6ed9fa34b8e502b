"""Generic operators against pandas / hand-computed results."""

from __future__ import annotations

import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import money, text
from ledgerlens.operators.growth import calendar_change, pct_change
from ledgerlens.operators.quality import assert_clean, null_report, rule_report
from ledgerlens.operators.ranking import top1, top1_per_group
from ledgerlens.operators.reshape import natural_merge, presence_pivot, union_distinct
from ledgerlens.operators.shares import share_of_group


def test_pct_change_matches_pandas(spark):
    rnd = random.Random(7)
    data = []
    for k in "abcde":
        years = sorted(rnd.sample(range(1995, 2003), rnd.randint(1, 6)))
        data += [(k, y, float(rnd.randint(1, 1000))) for y in years]
    pdf = pd.DataFrame(data, columns=["k", "y", "v"]).sort_values(["k", "y"])
    pdf["g"] = pdf.groupby("k").v.pct_change(periods=1)
    got = pct_change(spark.createDataFrame(data, "k string, y int, v double"), ["k"], "y", "v", "g").toPandas()
    merged = pdf.merge(got, on=["k", "y"], suffixes=("_pd", "_sp"))
    assert len(merged) == len(pdf)
    for a, b in zip(merged.g_pd, merged.g_sp):
        assert (pd.isna(a) and pd.isna(b)) or a == pytest.approx(b)


def test_calendar_change_skips_gaps(spark):
    df = spark.createDataFrame([("a", 1996, 10.0), ("a", 1998, 30.0), ("a", 1999, 60.0)], "k string, y int, v double")
    got = {r.y: r.g for r in calendar_change(df, ["k"], "y", "v", "g").collect()}
    assert got[1996] is None and got[1998] is None and got[1999] == pytest.approx(1.0)


def test_natural_merge_null_keys_and_sides(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20), ("y", 30)], "k string, b int")
    right = {(r.k, r.a, r.b) for r in natural_merge(a, b, "right").collect()}
    assert right == {("x", 1, 10), (None, 2, 20), ("y", None, 30)}
    left = {(r.k, r.a, r.b) for r in natural_merge(a, b, "left").collect()}
    assert left == {("x", 1, 10), (None, 2, 20)}
    inner = natural_merge(a, b, "inner")
    assert inner.columns == ["k", "a", "b"] and inner.count() == 2


def test_presence_pivot(spark):
    df = spark.createDataFrame([("x", 1, 5.0), ("x", 2, 6.0), ("y", 2, 7.0)], "k string, p int, v double")
    got = {r.k: r for r in presence_pivot(df, ["k"], "p", {"v1": (1, "v"), "v2": (2, "v")}, {"in1": 1}).collect()}
    assert got["x"].v1 == 5.0 and got["x"].in1 is True
    assert got["y"].v1 is None and got["y"].in1 is False


def test_share_of_group_zero_guard(spark):
    df = spark.createDataFrame([(1, Decimal("0")), (1, Decimal("0")), (2, Decimal("3")), (2, Decimal("1"))],
                               "o int, d decimal(18,4)")
    got = sorted((r.o, r.s) for r in share_of_group(df, ["o"], {"s": "d"}, zero_guard=("s",)).collect())
    assert got == [(1, 0.0), (1, 0.0), (2, 0.25), (2, 0.75)]


def test_top1_ties_are_deterministic(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", 1), (2, "z", 3)], "g int, n string, v int")
    got = {(r.g, r.n) for r in top1_per_group(df, ["g"], "v", ["n"], ["n", "v"]).collect()}
    assert got == {(1, "a"), (2, "z")}
    assert top1(df, "v", ["g", "n"], ["g", "n"]).collect()[0].asDict() == {"g": 1, "n": "a"}


def test_union_distinct(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(2,), (3,)], "x int")
    assert sorted(r.x for r in union_distinct(a, b).collect()) == [1, 2, 3]


def test_money_helpers(spark):
    df = spark.createDataFrame([(Decimal("1.1500"), 1, Decimal("0.1000"), Decimal("2.675"))],
                               "p decimal(18,4), q int, d decimal(9,4), x decimal(10,3)")
    r = df.select(money.net_sales(F.col("p"), F.col("q"), F.col("d")).alias("n"),
                  money.round_money(F.col("x")).alias("r"),
                  money.div_half_up(F.lit(5), F.lit(2)).alias("h"),
                  money.div_half_up(F.lit(5), F.lit(0)).alias("z"),
                  money.avg_rounded(F.lit(10050), F.lit(2), 4, 2).alias("a"),
                  money.unit_price_from_gross(F.lit(Decimal("10.00")).cast("decimal(18,4)"), F.lit(3)).alias("u")).first()
    assert r.n == Decimal("1.0400") and r.r == Decimal("2.6800")
    assert r.h == 3 and r.z is None
    assert r.a == Decimal("0.50")          # 1.005 / 2 = 0.5025 -> 0.50
    assert r.u == Decimal("3.3333")


def test_text_helpers(spark):
    df = spark.createDataFrame([(None, "John", "Doe", "Norway")], "t string, f string, l string, c string")
    r = df.select(text.full_name(F.col("t"), F.col("f"), F.col("l")).alias("n"),
                  text.concat_strict(F.col("t"), "x").alias("s"),
                  text.like_any(F.col("c"), ["%norw%"]).alias("m")).first()
    assert r.n == " J. Doe" and r.s is None and r.m is True


def test_quality_reports(spark):
    df = spark.createDataFrame([(None, "abcdef"), (3_000_000_000, "ab")], "k long, s string")
    nulls = {r.Column_Name: r.Null_Count for r in null_report(df, "t", ["k", "s"]).collect()}
    assert nulls == {"k": 1, "s": 0}
    rules = {(r.Column_Name, r.Rule): r.Violations for r in rule_report(df, "t", ["k"], {"s": 5}).collect()}
    assert rules == {("k", "INT"): 1, ("s", "NVARCHAR(5)"): 1}
    with pytest.raises(ValueError):
        assert_clean(null_report(df, "t", ["k"]), "Null_Count")


def test_cluster_conf_sizing():
    from ledgerlens.session import cluster_conf
    big = cluster_conf(100 * 10**12, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 745059
    small = cluster_conf(10 << 20, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16   # at least two waves

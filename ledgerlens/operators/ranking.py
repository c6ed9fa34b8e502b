"""Top-1 per group as an aggregate.

``min_by(struct(row), struct(-metric, tie_breakers))`` picks the best row of
each group in a single hash aggregation with map-side combine: no sort, no
window buffering a whole group in one task, deterministic on ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top1_per_group(df: DataFrame, by: list[str], metric: str, tie_break: list[str],
                   keep: list[str], descending: bool = True) -> DataFrame:
    m = F.col(metric)
    order_key = F.struct((-m if descending else m).alias("m"), *[F.col(c) for c in tie_break])
    best = F.min_by(F.struct(*[F.col(c) for c in keep]), order_key).alias("__best")
    g = df.where(m.isNotNull()).groupBy(*by).agg(best)
    return g.select(*by, *[F.col(f"__best.{c}").alias(c) for c in keep])


def top1(df: DataFrame, metric: str, tie_break: list[str], keep: list[str],
         descending: bool = True) -> DataFrame:
    """Global top row (``ORDER BY metric DESC LIMIT 1``) as an aggregate."""
    m = F.col(metric)
    order_key = F.struct((-m if descending else m).alias("m"), *[F.col(c) for c in tie_break])
    g = df.where(m.isNotNull()).agg(F.min_by(F.struct(*[F.col(c) for c in keep]), order_key).alias("__best"))
    return g.where(F.col("__best").isNotNull()).select(*[F.col(f"__best.{c}").alias(c) for c in keep])


def rank_desc(metric: str, *tie_break: str) -> list[Column]:
    return [F.col(metric).desc(), *[F.col(c).asc() for c in tie_break]]

"""Growth operators: period-over-period change on entity x period tables.

The input of every growth job is already aggregated to one row per entity and
period, so a window partitioned by entity holds only that entity's periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.money import ratio


def pct_change(df: DataFrame, entity: list[str], period: str, value: str, out: str) -> DataFrame:
    """``x / previous row's x - 1`` within ``entity`` ordered by ``period``.

    Row semantics: a missing period is skipped over (the previous *row* is the
    base). The first row, a NULL base and a zero base give NULL.
    """
    w = Window.partitionBy(*entity).orderBy(period)
    prev = F.lag(F.col(value), 1).over(w)
    return df.withColumn(out, ratio(F.col(value), prev) - F.lit(1.0))


def calendar_change(df: DataFrame, entity: list[str], period: str, value: str, out: str,
                    step: int = 1) -> DataFrame:
    """Like :func:`pct_change` but the base must be exactly ``period - step``;
    otherwise NULL (a gap year is not compared with an older year)."""
    w = Window.partitionBy(*entity).orderBy(period)
    prev = F.lag(F.col(value), 1).over(w)
    prev_period = F.lag(F.col(period), 1).over(w)
    base = F.when(prev_period == F.col(period) - F.lit(step), prev)
    return df.withColumn(out, ratio(F.col(value), base) - F.lit(1.0))

"""Cumulative (running) averages by period.

``AVG(x) OVER (PARTITION BY k ORDER BY year)`` uses the default RANGE frame:
every row of the entity up to and including the current year. Computed here
from per-(entity, year) sums and counts, so the window runs over a handful of
pre-aggregated rows per entity instead of every line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(pre: DataFrame, entity: list[str], period: str, cols: list[str]) -> DataFrame:
    """Replace each ``c`` in ``cols`` by its cumulative sum up to the current
    period (peers included) within ``entity``."""
    w = Window.partitionBy(*entity).orderBy(period).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = pre
    for c in cols:
        out = out.withColumn(c, F.sum(c).over(w))
    return out

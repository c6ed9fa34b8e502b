"""Share-of-total and period-divisor operators.

A share ``x / SUM(x) OVER (PARTITION BY g)`` is planned as an aggregate of
``g`` joined back, never as a window: a window puts the whole group into one
task, while the aggregate is combined map-side and its join is split by AQE
when one key is hot. Per-period totals are a scalar subquery: one map from
period to totals, read by every column that divides by them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.money import ratio


def group_totals(df: DataFrame, by: list[str], values: dict[str, Column | str]) -> DataFrame:
    """``by`` + one summed column per entry of ``values`` (name -> expression)."""
    aggs = [F.sum(v if isinstance(v, Column) else F.col(v)).alias(n) for n, v in values.items()]
    return df.groupBy(*by).agg(*aggs)


def period_lookup(totals: DataFrame, period: str) -> Callable[[Column, str], Column]:
    """``look(period column, name)``: a period's value of one column of
    ``totals`` (one row per period), NULL for a period that has none.

    The totals are gathered by a scalar subquery into one map; Spark runs it
    once for all columns that look something up. A calendar's periods are the
    bound of its size."""
    names = [c for c in totals.columns if c != period]
    entry = F.struct(F.col(period).alias("key"), F.struct(*names).alias("value"))
    by_period = totals.where(F.col(period).isNotNull()).agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()

    def look(key: Column, name: str) -> Column:
        return F.try_element_at(by_period, key)[name]

    return look


def share(value: Column, total: Column, zero_guard: bool = False) -> Column:
    """``value / total`` as DOUBLE (NULL for a zero total); with ``zero_guard``
    a zero value gives 0 without looking at the total."""
    r = ratio(value, total)
    return F.when(value == 0, F.lit(0.0)).otherwise(r) if zero_guard else r


def share_of_group(df: DataFrame, by: list[str], values: dict[str, str], zero_guard: tuple[str, ...] = ()) -> DataFrame:
    """Add ``<out> = value / sum(value) over by`` for each ``out -> value``. Spark
    broadcasts the totals if they are small."""
    tot = group_totals(df, by, {f"__tot_{o}": v for o, v in values.items()})
    j = df.join(tot, by, "left")
    for out, v in values.items():
        j = j.withColumn(out, share(F.col(v), F.col(f"__tot_{out}"), out in zero_guard))
    return j.drop(*[f"__tot_{o}" for o in values])

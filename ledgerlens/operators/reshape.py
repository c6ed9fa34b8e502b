"""Reshaping operators: pandas-style natural merges, year pivots, union of slices.

``natural_merge`` reproduces ``left.merge(right, how=...)`` without ``on``:
the join keys are all shared column names, NULL keys match each other, the
kept side decides the rows, and non-key columns keep their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def natural_merge(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """pandas ``merge(how=...)`` on all shared column names (null-safe keys).

    Key columns are renamed on both sides before the join, so slices of one
    DataFrame can be merged with each other without ambiguous references.
    """
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("natural merge needs at least one shared column")
    lhs = left.select(*[F.col(c).alias(f"__l_{c}") if c in keys else F.col(c) for c in left.columns])
    rhs = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}")) for c in keys])
    j = lhs.join(rhs, cond, how)
    out = []
    for c in left.columns:
        if c in keys:
            if how == "right":
                out.append(F.col(f"__r_{c}").alias(c))
            elif how in ("left", "inner", "left_outer"):
                out.append(F.col(f"__l_{c}").alias(c))
            else:
                out.append(F.coalesce(F.col(f"__l_{c}"), F.col(f"__r_{c}")).alias(c))
        else:
            out.append(F.col(c))
    out += [F.col(c) for c in right.columns if c not in keys]
    return j.select(*out)


def slice_rows(df: DataFrame, period_col: str, value, keep: list[str],
               rename: dict[str, str] | None = None) -> DataFrame:
    """Rows of one period, a column subset, renamed (``query`` + ``iloc`` + ``rename``)."""
    s = df.where(F.col(period_col) == F.lit(value)).select(*keep)
    return s.withColumnsRenamed(rename) if rename else s


def fill_numeric(df: DataFrame, value=0, subset: list[str] | None = None) -> DataFrame:
    """``fillna(0)`` restricted to numeric columns (text keys stay NULL)."""
    num = [f.name for f in df.schema.fields
           if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]
    cols = [c for c in (subset or num) if c in num]
    return df.fillna(value, subset=cols) if cols else df


def union_distinct(*parts: DataFrame) -> DataFrame:
    """SQL ``UNION``: set semantics, column names from the first input."""
    return reduce(lambda a, b: a.union(b), parts).distinct()


def presence_pivot(df: DataFrame, keys: list[str], period_col: str,
                   cells: dict[str, tuple[object, str]], flags: dict[str, object]) -> DataFrame:
    """One row per entity (NULL keys group together) in a single aggregation.

    ``cells`` maps an output column to ``(period, source column)``; ``flags``
    maps an output column to a period and is true when the entity has a row in
    that period. Together they express a chain of natural merges of period
    slices (which rows survive, which cells are kept) without joining the
    slices back to each other. Assumes one row per entity and period.
    """
    aggs = [F.max(F.when(F.col(period_col) == F.lit(p), F.col(src))).alias(out)
            for out, (p, src) in cells.items()]
    aggs += [F.max(F.col(period_col) == F.lit(p)).alias(out) for out, p in flags.items()]
    return df.groupBy(*keys).agg(*aggs)

"""Table constraints: NOT NULL, integer and length rules, as counts and as a gate.

The source tightens column types after loading a table (NOT NULL keys, INT,
NVARCHAR(n)). :func:`null_report` and :func:`rule_report` count violations, all
rules of a table in one aggregate. ``sources.sinks.publish_table`` enforces the
same :class:`Rules` while it writes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Constraints of one table: columns that hold no NULL, columns stored as
    INT, and the longest text of columns."""

    not_null: Sequence[str] = ()
    ints: Sequence[str] = ()
    max_len: Mapping[str, int] = field(default_factory=dict)

    def column_type(self, name: str, stored: str) -> str:
        """A column's type in the table's definition."""
        kind = "INT" if name in self.ints else f"VARCHAR({self.max_len[name]})" if name in self.max_len else stored
        return kind + (" NOT NULL" if name in self.not_null else "")


def _counted(df: DataFrame, table: str, checks: list[tuple[dict[str, str], Column]], into: str, rows: bool = False) -> DataFrame:
    """A row for each check, with the number of rows for which it holds: one
    aggregate over the table, its counts laid out as rows."""
    counts = [F.count_if(condition).alias(f"n{i}") for i, (_, condition) in enumerate(checks)]
    one = df.agg(F.count(F.lit(1)).alias("all"), *counts)
    cells = [
        F.struct(F.lit(table).alias("Table_Name"), *[F.lit(v).alias(k) for k, v in labels.items()], F.col(f"n{i}").alias(into), *([F.col("all").alias("Row_Count")] if rows else []))
        for i, (labels, _) in enumerate(checks)
    ]
    return one.select(F.inline(F.array(*cells)))


def null_report(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """One row per column: NULL count and row count."""
    return _counted(df, table, [({"Column_Name": c}, F.col(c).isNull()) for c in cols], "Null_Count", rows=True)


def rule_report(df: DataFrame, table: str, int_cols: Sequence[str] = (), max_len: Mapping[str, int] | None = None) -> DataFrame:
    """Violations of ``INT`` (value not representable as a 32-bit integer) and
    ``NVARCHAR(n)`` (longer than n characters) rules, one row per rule."""
    checks = [({"Column_Name": c, "Rule": "INT"}, F.col(c).isNotNull() & F.col(c).cast("string").try_cast("int").isNull()) for c in int_cols]
    checks += [({"Column_Name": c, "Rule": f"NVARCHAR({n})"}, F.length(c) > F.lit(n)) for c, n in (max_len or {}).items()]
    return _counted(df, table, checks, "Violations")


def assert_clean(report: DataFrame, count_col: str) -> None:
    """Raise if any rule of a report has violations (runs one small job)."""
    bad = report.where(F.col(count_col) > 0).collect()
    if bad:
        raise ValueError(f"constraint violations: {[r.asDict() for r in bad]}")

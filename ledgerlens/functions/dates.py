"""Date expressions and calendar periods.

Period slices are written as half-open date ranges on the raw date column, so
Catalyst can turn them into parquet min/max pushdown (``YEAR(d) = y AND
MONTH(d) >= 7`` would not prune).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: missing ship dates are imputed as order date + 8 days.
IMPUTE_DAYS = 8


def impute_date(value: Column, base: Column, days: int = IMPUTE_DAYS) -> Column:
    """NULL date replaced by ``base + days``."""
    return F.when(value.isNull(), F.date_add(base, days)).otherwise(value)


def days_between(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end`` (``DATEDIFF(DD, start, end)``)."""
    return F.datediff(end, start)


@dataclass(frozen=True)
class Period:
    """Calendar slice [first_month, last_month] of one year."""

    year: int
    first_month: int = 1
    last_month: int = 12

    @property
    def start(self) -> dt.date:
        return dt.date(self.year, self.first_month, 1)

    @property
    def end(self) -> dt.date:
        if self.last_month == 12:
            return dt.date(self.year + 1, 1, 1)
        return dt.date(self.year, self.last_month + 1, 1)

    @property
    def half(self) -> str | None:
        if (self.first_month, self.last_month) == (1, 6):
            return "H1"
        if (self.first_month, self.last_month) == (7, 12):
            return "H2"
        return None

    @property
    def halves(self) -> list[int]:
        """Codes (see ``half_code``) of the half-years that it touches."""
        return [self.year * 10 + h for h in (1, 2) if self.first_month <= 6 * h and self.last_month > 6 * (h - 1)]

    def contains(self, d: Column) -> Column:
        return (d >= F.lit(self.start)) & (d < F.lit(self.end))


def half_code(d: Column) -> Column:
    """A date's half-year as a number: 19971 for January-June 1997, 19972 for
    the rest of it."""
    return F.year(d) * 10 + F.when(F.month(d) <= 6, 1).otherwise(2)


def year_period(year: int) -> Period:
    return Period(year, 1, 12)


def first_half(year: int) -> Period:
    return Period(year, 1, 6)


def second_half(year: int) -> Period:
    return Period(year, 7, 12)


def in_any(d: Column, periods) -> Column:
    cond = None
    for p in periods:
        c = p.contains(d)
        cond = c if cond is None else (cond | c)
    return cond if cond is not None else F.lit(False)


# The half-years that are compared.
H2_SLICES = (second_half(1996), second_half(1997))
H1_SLICES = (first_half(1997), first_half(1998))

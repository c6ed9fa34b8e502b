"""Text expressions: prefixes, the two concatenation semantics, readable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def left(s: Column, n: int) -> Column:
    """``LEFT(s, n)``; NULL stays NULL."""
    return F.substring(s, 1, n)


def concat_strict(*parts) -> Column:
    """``a + b`` on strings: any NULL part makes the result NULL."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def concat_lenient(*parts) -> Column:
    """``CONCAT(a, b, ...)``: NULL parts count as empty strings."""
    return F.concat_ws("", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def like_any(c: Column, patterns, case_insensitive: bool = True) -> Column:
    """OR of LIKE patterns; case-insensitive by default like the source collation."""
    cond = None
    for pat in patterns:
        m = c.ilike(pat) if case_insensitive else c.like(pat)
        cond = m if cond is None else (cond | m)
    return cond if cond is not None else F.lit(False)


def full_name(courtesy: Column, first: Column, last: Column) -> Column:
    """Courtesy title, initial with a full stop and last name; missing parts are
    left empty."""
    return concat_lenient(courtesy, " ", left(first, 1), ". ", last)

"""Column-expression library (all JVM-side, no Python UDFs)."""

from ledgerlens.functions import dates, money, text

__all__ = ["dates", "money", "text"]

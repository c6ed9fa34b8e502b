"""Exact money arithmetic as native Column expressions.

Money is DECIMAL(18,4): the widest decimal Spark keeps as a compact 64-bit
value (row storage, cache, arithmetic), with room for +-99 trillion. Every
rounding is HALF_UP on decimals, which Spark and DuckDB agree on. Where a rounded value would otherwise come from a division
(freight allocation, rounded averages, unit prices), the rounding is done on
the integers' absolute values with ``(2*num + den) div (2*den)``, and the sign
put back, so no engine-specific floating point tie-breaking can leak into the
result and a return line rounds like the sale that it undoes.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 4)
RATE = DecimalType(9, 4)
MONEY_SUM = DecimalType(28, 4)

# The modelled business rules.
PROFIT_MARGIN = Decimal("0.07")   # profit is 7 % of net sales (and of gross for expected profit)
MONEY_SCALE = 2                   # money is rounded to cents


def dec(value) -> Column:
    """Decimal literal (a Python float would turn the expression into DOUBLE)."""
    return F.lit(Decimal(str(value)))


def to_money(c: Column) -> Column:
    return c.cast(MONEY)


def round_money(c: Column, scale: int = MONEY_SCALE) -> Column:
    """``CAST(ROUND(x, 2) AS MONEY)``."""
    return F.round(c, scale).cast(MONEY)


def cast_decimal(c: Column, scale: int, precision: int = 10) -> Column:
    """``CAST(ROUND(x, s) AS DECIMAL(p, s))``."""
    return F.round(c, scale).cast(DecimalType(precision, scale))


def net_sales(unit_price: Column, quantity: Column, discount: Column) -> Column:
    """Line net sales: round(price * qty * (1 - discount), 2) as money."""
    return net_from_gross(to_money(unit_price * quantity), discount)


def net_from_gross(gross: Column, discount: Column) -> Column:
    """Same rule when the line gross (price * qty, as money) is already known."""
    return round_money(gross * (F.lit(1) - discount))


def discount_amount(gross: Column, discount: Column) -> Column:
    return round_money(gross * discount)


def line_units(price: Column, quantity: Column, discount: Column) -> dict[str, Column]:
    """A line's money as integers, from its unit price and discount rate in units
    of 10^-4: gross in 10^-4, the others in cents. The rules are those of
    ``net_sales``, ``discount_amount`` and ``margin``, without a decimal
    in between, so that sums of lines stay in generated code."""
    gross = price.cast("bigint") * quantity
    net = div_half_up(gross * (F.lit(10_000) - discount), F.lit(10 ** 6))
    percent = int(PROFIT_MARGIN * 100)
    return {
        "gross": gross,
        "off": div_half_up(gross * discount, F.lit(10 ** 6)),
        "net": net,
        "profit": div_half_up(net * percent, F.lit(100)),
        "expected": div_half_up(gross * percent, F.lit(10 ** 4)),
    }


def sum_units(units: Column, scale: int, over: WindowSpec | None = None) -> Column:
    """Sum of integers of 10^-scale units as DECIMAL(28,4), of a group or ``over`` a
    window. Cents are added up as they are; finer units as cents and the rest of a
    cent, so that the sum has room for 9 * 10^16 (Spark raises beyond it)."""
    if scale <= MONEY_SCALE:
        return from_units(sum_over(units, over), scale, 28).cast(MONEY_SUM)
    step = F.lit(10 ** (scale - MONEY_SCALE))
    whole, rest = sum_over(F.call_function("div", units, step), over), sum_over(units % step, over)
    return (from_units(whole, MONEY_SCALE, 28) + from_units(rest, scale, 28)).cast(MONEY_SUM)


def sum_over(c: Column, over: WindowSpec | None = None) -> Column:
    return F.sum(c) if over is None else F.sum(c).over(over)


def margin(amount: Column, rate: Decimal = PROFIT_MARGIN) -> Column:
    """Profit at a fixed margin, rounded per line."""
    return round_money(amount * dec(rate))


def to_units(c: Column, scale: int) -> Column:
    """Exact decimal -> integer count of 10^-scale units (BIGINT)."""
    return (c * F.lit(10 ** scale)).cast("bigint")


def from_units(units: Column, scale: int, precision: int = 18) -> Column:
    """Integer count of 10^-scale units -> DECIMAL(precision, scale)."""
    return (units.cast(DecimalType(precision, 0)) * dec(Decimal(1).scaleb(-scale))).cast(
        DecimalType(precision, scale))


def div_half_up(num: Column, den: Column) -> Column:
    """round(num / den) for integers of any sign, halves away from zero (as
    HALF_UP); NULL when den is 0 or NULL."""
    n = num.cast("bigint")
    d = den.cast("bigint")
    size = F.call_function("div", F.abs(n) * 2 + F.abs(d), F.abs(d) * 2)
    return F.when(d != 0, F.when((n < 0) != (d < 0), -size).otherwise(size))


def avg_rounded(sum_units: Column, count: Column, units_scale: int, scale: int) -> Column:
    """Average rounded half up to ``scale`` decimals, from an exact sum in units.

    ``sum_units`` counts 10^-units_scale units; the result is DECIMAL(18, scale).
    """
    factor = 10 ** (units_scale - scale)
    return from_units(div_half_up(sum_units, count.cast("bigint") * F.lit(factor)), scale)


def unit_price_from_gross(gross: Column, quantity: Column) -> Column:
    """MONEY unit price = gross / quantity rounded half up to 4 decimals."""
    return from_units(div_half_up(to_units(gross, 4), quantity), 4)


def ratio(num: Column, den: Column, scale: int | None = None) -> Column:
    """num / den as DOUBLE; NULL for a zero or NULL divisor (never inf). With
    ``scale``, as money divided by money is kept: a decimal of that many
    digits, rounded half up from the exact amounts (in units of 10^-4)."""
    if scale is None:
        return F.try_divide(num.cast("double"), den.cast("double"))
    return from_units(div_half_up(to_units(num, 4) * F.lit(10 ** scale), to_units(den, 4)), scale)

"""Exact money, rounded only where a figure leaves the engine.

Tables hold decimals. While lines are summed, amounts are whole numbers: units of
1/10000 for amounts as they arrive, and of 1e-9 for discount shares. Whole numbers
stay in long registers, where wide decimals would be objects.

All helpers take and return SQL expression text for ``selectExpr`` and ``expr``.
"""

from __future__ import annotations

from decimal import Decimal

MONEY = "decimal(18,4)"  # prices, discounts and costs as they arrive
SHARE = "decimal(19,9)"  # a line's part of an order discount (does not terminate)
AMOUNT = "decimal(26,10)"  # any figure derived from the two above
RATE = "decimal(12,8)"

UNITS = 4
SHARE_UNITS = 9
_LOW_BITS = 20


def quote(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cast(x: str, dtype: str) -> str:
    return f"cast({x} as {dtype})"


def total(x: str) -> str:
    """Sum that ignores missing values and gives 0 when all are missing."""
    return f"coalesce(sum({x}), 0)"


def to_units(x: str) -> str:
    """A decimal(18,4) amount as a whole number of 1/10000."""
    return f"cast({x} * {10**UNITS} as bigint)"


def _unit(scale: int) -> str:
    return f"{Decimal(1).scaleb(-scale):f}"


def from_units(units: str, scale: int = UNITS, dtype: str = MONEY) -> str:
    return f"cast(cast({units} as decimal(19,0)) * {_unit(scale)} as {dtype})"


def sum_units(units: str, scale: int = UNITS) -> str:
    """Exact decimal sum of whole-number amounts; 0 when all are missing.

    High and low bits are summed apart, so neither long can overflow even for the
    lines of a whole shop.
    """
    high = f"cast(sum(shiftright({units}, {_LOW_BITS})) as decimal(19,0))"
    low = f"cast(sum(({units}) & {(1 << _LOW_BITS) - 1}) as decimal(19,0))"
    whole = f"cast({high} * {1 << _LOW_BITS} + {low} as decimal(28,0))"
    return f"coalesce(cast({whole} * {_unit(scale)} as decimal(28,{scale})), 0)"


def without_vat(x: str, vat_rate: Decimal) -> str:
    """Amount excluding VAT. 25 % is exactly a factor of 0.8 in decimals."""
    gross = 1 + vat_rate
    factor = Decimal(1) / gross
    if factor * gross == 1:
        return f"cast(({x}) * {factor:f} as {AMOUNT})"
    return f"cast(({x}) / {gross:f} as {AMOUNT})"


def money_out(x: str) -> str:
    """Two decimals as a double.

    Discount shares carry nine decimals; rounding at six first keeps their last
    digit from deciding a tie at the third.
    """
    return f"cast(round(cast({x} as decimal(38,6)), 2) as double)"


def as_double(x: str) -> str:
    """Six decimals as a double, for output and for divisions."""
    return f"cast(cast({x} as decimal(38,6)) as double)"


def guarded_ratio(num: str, den: str, scale: float = 1.0) -> str:
    """num / den * scale, or 0 when the denominator is not positive."""
    den = as_double(den)
    return (
        f"case when {den} > 0 then {as_double(num)} / nullif({den}, 0d) * {float(scale)}d "
        "else 0d end"
    )


def margin_pct(profit: str, revenue: str) -> str:
    """Percent with one decimal, half to even; missing when revenue is 0."""
    return f"bround({as_double(profit)} / nullif({as_double(revenue)}, 0d) * 100d, 1)"


def rounded(*names: str) -> list[str]:
    """Output expressions for columns that keep their names."""
    return [f"{money_out(name)} as {name}" for name in names]

"""Text clean-up for hand-kept sheets.

All helpers take and return SQL expression text.
"""

from __future__ import annotations

from profitloom.functions.money import MONEY, RATE, cast, quote

NBSP = "\u00a0"
# White space as Unicode sees it, plus the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"


def strip(x: str) -> str:
    """Trim every kind of white space, no-break space included."""
    pattern = quote(f"(?U)^{_SPACE}+|{_SPACE}+$")
    return f"regexp_replace({x}, {pattern}, '')"


def _number(x: str, dtype: str) -> str:
    return f"try_cast({strip(f'''replace({x}, ',', '.')''')} as {dtype})"


def _or_zero(x: str, dtype: str) -> str:
    return f"coalesce({x}, {cast('0', dtype)})"


def parse_currency(x: str) -> str:
    """``2 000,00 kr`` -> 2000.00; text that is no number counts as 0."""
    bare = f"regexp_replace({x}, {quote(f'kr|{NBSP}| ')}, '')"
    return _or_zero(_number(bare, MONEY), MONEY)


def parse_fixed_amount(x: str) -> str:
    """``12,50`` -> 12.50; anything else is missing."""
    return _number(x, MONEY)


def fee_rate(x: str) -> str:
    """The percentage of a rule like ``5% av ordrepris + 2 kr`` as a fraction."""
    percent = _number(f"split_part({x}, '%', 1)", RATE)
    parsed = f"if(contains({x}, '%'), {percent}, null)"
    return cast(f"{_or_zero(parsed, RATE)} / 100", RATE)


def fee_fixed(x: str) -> str:
    """The fixed part of a rule like ``5% av ordrepris + 2 kr``."""
    part = f"replace(split_part({x}, '+', 2), 'kr', '')"
    return _or_zero(f"if(contains({x}, '+'), {_number(part, MONEY)}, null)", MONEY)

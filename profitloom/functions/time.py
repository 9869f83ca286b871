"""Calendar expressions on shop wall-clock time; the session zone plays no part.

All helpers take and return SQL expression text.
"""

from __future__ import annotations


def wall_date(created_at: str) -> str:
    return f"to_date(left({created_at}, 10))"


def wall_hour(created_at: str) -> str:
    """Hour as the shop's clock showed it, whatever the offset in the text."""
    return f"cast(substring({created_at}, 12, 2) as int)"


def wall_seconds(created_at: str) -> str:
    """Wall-clock time as seconds, for event-time windows that follow shop days."""
    part = lambda at, weight: f"cast(substring({created_at}, {at}, 2) as bigint) * {weight}"
    days = f"cast(datediff({wall_date(created_at)}, date'1970-01-01') as bigint)"
    return f"({days} * 86400 + {part(12, 3600)} + {part(15, 60)} + {part(18, 1)})"


def week_start(day: str) -> str:
    """Monday of the week."""
    return f"date_sub({day}, weekday({day}))"

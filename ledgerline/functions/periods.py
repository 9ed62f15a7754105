"""Reporting periods: flags to inclusive bounds, named ranges, and the keys of days, weeks and months."""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Range ends are inclusive at millisecond precision.
_TICK = timedelta(milliseconds=1)
NAMED = ["today", "yesterday", "last24h", "thisWeek", "last30days"]


def _day(text: str) -> date:
    found = datetime.strptime(text, "%Y-%m-%d").date()
    if found.isoformat() != text:
        raise ValueError(f"not a date: {text}")
    return found


def _month_after(first: date) -> date:
    return (first.replace(day=28) + timedelta(days=4)).replace(day=1)


def _months_before(day: date, n: int) -> date:
    at = day.year * 12 + day.month - 1 - n
    year, month = divmod(at, 12)
    last = (_month_after(date(year, month + 1, 1)) - timedelta(days=1)).day
    return date(year, month + 1, min(day.day, last))


def resolve(now: datetime, last: str | None = None, month: str | None = None, since: str | None = None, until: str | None = None) -> tuple[datetime | None, datetime | None]:
    """(start, end), both inclusive, None for an open side. ``last`` is like 7d, 2w or 3m and goes back from
    this very moment; ``last``, ``month`` and since/until exclude one another. An inverted range is empty and no error."""
    if sum((last is not None, month is not None, since is not None or until is not None)) > 1:
        raise ValueError("give one of last, month, since/until")
    if last is not None:
        m = re.fullmatch(r"([1-9][0-9]*)([dwm])", last)
        if not m:
            raise ValueError(f"not a period: {last}")
        n, unit = int(m[1]), m[2]
        if unit == "m":
            return datetime.combine(_months_before(now.date(), n), now.time()), now
        return now - timedelta(days=n * (7 if unit == "w" else 1)), now
    if month is not None:
        first = _day(f"{month}-01")
        return datetime.combine(first, time()), datetime.combine(_month_after(first), time()) - _TICK
    start = datetime.combine(_day(since), time()) if since else None
    end = datetime.combine(_day(until) + timedelta(days=1), time()) - _TICK if until else None
    return start, end


def named_range(name: str, now: datetime, first_weekday: int = 0, custom: tuple[date, date] | None = None) -> tuple[datetime, datetime]:
    """Bounds of a named range; ``custom`` spans whole days and ends a second before midnight."""
    midnight = datetime.combine(now.date(), time())
    if custom:
        a, b = sorted(custom)
        return datetime.combine(a, time()), datetime.combine(b + timedelta(days=1), time()) - timedelta(seconds=1)
    if name == "today":
        return midnight, now
    if name == "yesterday":
        return midnight - timedelta(days=1), midnight - _TICK
    if name == "last24h":
        return now - timedelta(hours=24), now
    if name == "thisWeek":
        return midnight - timedelta(days=(now.weekday() - first_weekday) % 7), now
    if name == "last30days":
        return now - timedelta(days=30), now
    raise ValueError(f"unknown range: {name}")


def day_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def hour_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH")


def month_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def week_start(at: Column, first_weekday: int = 0) -> Column:
    """Date of the first day of the week; 0 is Monday, as in ISO weeks."""
    day = at.cast("date")
    return F.date_sub(day, (F.weekday(day) - first_weekday + 7) % 7)


def week_key(at: Column, first_weekday: int = 0) -> Column:
    return F.date_format(week_start(at, first_weekday), "yyyy-MM-dd")


BUCKET_KEYS = {"hour": hour_key, "day": day_key, "week": week_key, "month": month_key}

"""Calendar functions over epoch milliseconds, in UTC. Months count from 0, weeks start on Sunday."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _week(day: Column, first_weekday: Column) -> Column:
    """Week of a day counted from 1, where the first day is on first_weekday (Sunday = 1): week 1 holds it."""
    return F.floor((day - 1 + first_weekday - 1) / 7).cast("int") + 1


def calendar_field(ms: Column, name: str) -> Column:
    """One field of a time; null for a name that is not known."""
    t = F.timestamp_millis(ms)
    year_week = _week(F.dayofyear(t), F.dayofweek(F.trunc(t, "year")))
    days = F.dayofyear(F.last_day(F.make_date(F.year(t), F.lit(12), F.lit(1))))
    # the last days of a year are in week 1 of the next, if that starts within their week
    turn = (F.dayofweek(t) - 1) + (days - F.dayofyear(t)) < 6
    fields = {
        "YEAR": lambda: F.year(t),
        "MONTH": lambda: F.month(t) - 1,
        "DATE": lambda: F.dayofmonth(t),
        "DAY_OF_MONTH": lambda: F.dayofmonth(t),
        "HOUR": lambda: F.hour(t),
        "MINUTE": lambda: F.minute(t),
        "SECOND": lambda: F.second(t),
        "MILLISECOND": lambda: F.pmod(ms, F.lit(1000)).cast("int"),
        "DAY_OF_WEEK": lambda: F.dayofweek(t),
        "DAY_OF_YEAR": lambda: F.dayofyear(t),
        "WEEK_OF_MONTH": lambda: _week(F.dayofmonth(t), F.dayofweek(F.trunc(t, "month"))),
        "WEEK_OF_YEAR": lambda: F.when(turn, F.lit(1)).otherwise(year_week),
    }
    return fields[name]() if name in fields else F.lit(None).cast("int")


def epoch_to_calendar(ms: Column, *fields: str) -> Column:
    """Struct of calendar fields, named in lower case."""
    return F.struct(*[calendar_field(ms, f).alias(f.lower()) for f in fields])


def calendar_to_epoch(value: Column, *fields: str) -> Column:
    """Epoch milliseconds from a struct of fields in the given order; fields left out are zero. Unknown names raise."""
    known = {"YEAR", "MONTH", "DATE", "DAY_OF_MONTH", "HOUR", "MINUTE", "SECOND", "MILLISECOND"}
    if bad := [f for f in fields if f not in known]:
        raise ValueError(f"unknown calendar fields: {bad}")
    at = {("DATE" if f == "DAY_OF_MONTH" else f): value[f.lower()] for f in fields}
    zero = F.lit(0)
    day = F.make_date(at.get("YEAR", F.lit(1)), F.lit(1), F.lit(1))
    day = F.date_add(F.add_months(day, at.get("MONTH", zero)), at.get("DATE", F.lit(1)) - 1)
    seconds = at.get("HOUR", zero) * 3600 + at.get("MINUTE", zero) * 60 + at.get("SECOND", zero)
    return F.unix_date(day).cast("long") * 86_400_000 + seconds.cast("long") * 1000 + at.get("MILLISECOND", zero)


def split_key(ms: Column) -> tuple[Column, Column]:
    """(date yyyy-MM-dd, hour of 24) of a time."""
    t = F.timestamp_millis(ms)
    return F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "HH")


_DATE = re.compile(r"(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2})(?:[T ](\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.\d+)?)?)?)?)?)?Z?$", re.I)
_NOW = re.compile(r"NOW((?:[+-]\d+(?:YEAR|MONTH|DAY|HOUR|MINUTE|SECOND)S?)*)(?:/(YEAR|MONTH|DAY|HOUR|MINUTE|SECOND)S?)?$", re.I)
_UNITS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")


def _add(t: dt.datetime, n: int, unit: str) -> dt.datetime:
    if unit in ("YEAR", "MONTH"):
        months = t.year * 12 + t.month - 1 + n * (12 if unit == "YEAR" else 1)
        year, month = divmod(months, 12)
        return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))
    return t + dt.timedelta(**{unit.lower() + "s": n})


def date_bounds(text: str, now: dt.datetime | None = None) -> tuple[dt.datetime, dt.datetime] | None:
    """First and last moment of a partial date or NOW expression; None if it is no date."""
    if m := _NOW.match(text.strip()):
        t = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        for sign, n, unit in re.findall(r"([+-])(\d+)(YEAR|MONTH|DAY|HOUR|MINUTE|SECOND)S?", m[1], re.I):
            t = _add(t, int(sign + n), unit.upper())
        if m[2]:
            keep = _UNITS.index(m[2].upper())
            t = dt.datetime(*[v if i <= keep else (1 if i < 3 else 0) for i, v in enumerate(t.timetuple()[:6])])
        return t, t
    m = _DATE.match(text.strip())
    if not m:
        return None
    parts = [int(x) for x in m.groups() if x is not None]
    try:
        low = dt.datetime(*(parts + [1, 1][len(parts) - 1 :] if len(parts) < 3 else parts))
    except ValueError:
        return None
    if len(parts) == 6:
        return low, low
    return low, _add(low, 1, _UNITS[len(parts) - 1]) - dt.timedelta(milliseconds=1)

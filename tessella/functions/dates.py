"""Date and time functions. Parts and units are plain texts, read when the query is built."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.expr import Expr, call
from tessella.functions.registry import scalar

year, month, day = scalar(F.year), scalar(F.month), scalar(F.dayofmonth)
hour, minute, second, quarter = scalar(F.hour), scalar(F.minute), scalar(F.second), scalar(F.quarter)
#: The ISO week.
week_of_year = scalar(F.weekofyear)
end_of_month = scalar(F.last_day)
now, current_date, unix_timestamp = scalar(F.current_timestamp), scalar(F.current_date), scalar(F.unix_timestamp)
local_timestamp = scalar(F.localtimestamp)
from_unix_time = scalar(F.timestamp_seconds)

UNITS = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")


def _unit(unit: str) -> str:
    if unit.lower().removesuffix("s") not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return unit.lower().removesuffix("s")


def current_time() -> Expr:
    """The session's time of day, as text: hours, minutes and seconds (columns of times are off in Spark, unless switched on)."""
    return call("current_time", lambda: F.date_format(F.localtimestamp(), "HH:mm:ss"))


local_time = current_time


def utc_now() -> Expr:
    return call("utc_now", lambda: F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


@scalar
def day_of_week(d: Column) -> Column:
    """0 on Sunday to 6."""
    return F.dayofweek(d) - 1


def extract(part: str, d: Any) -> Expr:
    """A part as a whole number; the day of the week is 0 on Sunday."""
    if part.lower() in ("dow", "dayofweek"):
        return day_of_week(d)
    return call(f"extract:{part}", lambda c: F.extract(F.lit(part), c), d)


def date_add(d: Any, n: int, unit: str) -> Expr:
    """n units later; the day of the month is held in the month."""
    return call(f"add{n}{unit}", lambda c: F.timestamp_add(_unit(unit), F.lit(n), c), d)


def date_sub(d: Any, n: int, unit: str) -> Expr:
    return date_add(d, -n, unit)


@scalar
def date_diff(a: Column, b: Column) -> Column:
    """Days from b to a."""
    return F.datediff(a, b)


#: strftime codes and their patterns in Java.
FORMATS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%f": "SSSSSS", "%%": "%"}


def date_format(d: Any, form: str) -> Expr:
    """By a strftime format."""

    def java(m: re.Match) -> str:
        if m[0].startswith("%"):
            if m[0] not in FORMATS:
                raise ValueError(f"unknown code {m[0]}")
            return FORMATS[m[0]]
        return "'" + m[0].replace("'", "''") + "'" if re.search("[A-Za-z']", m[0]) else m[0]

    return call(f"format:{form}", lambda c: F.date_format(c, re.sub(r"%.|[^%]+", java, form)), d)


def date_trunc(part: str, d: Any) -> Expr:
    return call(f"trunc:{part}", lambda c: F.date_trunc(part, c).cast("timestamp_ntz"), d)


def age(ts: Any, base: Any = None) -> Expr:
    """Years, months and days from ts to base (now, if none), as text: ``1 years 2 mons 3 days``; times of day don't count."""

    def make(a: Column, b: Column) -> Column:
        early, late = F.least(a, b).cast("date"), F.greatest(a, b).cast("date")
        short = F.dayofmonth(late) < F.dayofmonth(early)  # days are borrowed from the earlier date's month
        months = (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early) - short.cast("int")
        days = F.dayofmonth(late) - F.dayofmonth(early) + F.when(short, F.dayofmonth(F.last_day(early))).otherwise(0)
        sign = F.when(b < a, -1).otherwise(1)
        return F.concat(sign * F.floor(months / 12), F.lit(" years "), sign * (months % 12), F.lit(" mons "), sign * days, F.lit(" days"))

    return call("age", make, ts, now() if base is None else base)

"""Date and time functions over timestamps without zone, with chains of modifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_JULIAN = 2440587.5


def parse(x: Column) -> Column:
    """A timestamp from ISO text (date, date and time, or time of 2000-01-01), zone suffix dropped."""
    bare = F.regexp_replace(F.trim(x), r"(Z|[+-]\d\d:\d\d)$", "")
    full = F.regexp_replace(bare, "T", " ")
    full = F.when(full.rlike(r"^\d\d:\d\d"), F.concat(F.lit("2000-01-01 "), full)).otherwise(full)
    return full.try_cast("timestamp_ntz")


def unixepoch(ts: Column) -> Column:
    """Whole seconds since 1970."""
    return F.floor(seconds(ts)).cast("bigint")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 with fraction, whatever the session's zone."""
    micro = F.expr("timestamp_ntz '1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", micro, ts) / F.lit(1e6)


def julianday(ts: Column) -> Column:
    return seconds(ts) / F.lit(86400.0) + F.lit(EPOCH_JULIAN)


def from_julian(day: Column) -> Column:
    return F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((day - EPOCH_JULIAN) * 86400).cast("decimal(18,6)"))


def add_months(ts: Column, months: Column | int) -> Column:
    """Calendar months on; a day that the month doesn't have rolls over into the next."""
    months = F.lit(months) if isinstance(months, int) else months
    first = F.add_months(F.trunc(ts, "month"), months)
    day = F.date_add(first, F.dayofmonth(ts) - 1)
    return day.cast("timestamp_ntz") + (ts - F.date_trunc("day", ts).cast("timestamp_ntz"))


def weekday(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def modify(ts: Column, *modifiers: str) -> Column:
    """ts after the modifiers, in order: ±N unit, start of day/month/year, weekday N, and those that change nothing here."""
    for m in modifiers:
        m = m.strip().lower()
        if found := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*(second|minute|hour|day|week|month|year)s?", m):
            n, unit = float(found[1]), found[2]
            if unit in ("month", "year"):
                ts = add_months(ts, int(n) * (12 if unit == "year" else 1))
            else:
                ts = ts + F.expr(f"make_dt_interval(0, 0, 0, {n * {'second': 1, 'minute': 60, 'hour': 3600, 'day': 86400, 'week': 604800}[unit]:.6f})")
        elif found := re.fullmatch(r"start of (day|month|year)", m):
            ts = F.date_trunc(found[1], ts).cast("timestamp_ntz")
        elif found := re.fullmatch(r"weekday (\d)", m):
            ts = ts + F.make_dt_interval(F.pmod(F.lit(int(found[1])) - weekday(ts), F.lit(7)))
        elif m not in ("utc", "localtime", "unixepoch", "auto", "julianday", "subsec"):
            raise ValueError(f"unknown modifier: {m}")
    return ts


def strftime(pattern: str, ts: Column) -> Column:
    """Text of a constant pattern of % codes."""
    day, hour = F.dayofmonth(ts), F.hour(ts)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    wide = lambda x: F.lpad(x.cast("string"), 2, " ")
    hour12 = F.pmod(hour + 11, F.lit(12)) + 1
    yday = F.dayofyear(ts)
    codes = {
        "Y": lambda: F.date_format(ts, "yyyy"), "m": lambda: two(F.month(ts)), "d": lambda: two(day), "e": lambda: wide(day),
        "H": lambda: two(hour), "I": lambda: two(hour12), "k": lambda: wide(hour), "l": lambda: wide(hour12),
        "M": lambda: two(F.minute(ts)), "S": lambda: two(F.second(ts)), "j": lambda: F.lpad(yday.cast("string"), 3, "0"),
        "s": lambda: unixepoch(ts).cast("string"), "w": lambda: weekday(ts).cast("string"), "u": lambda: (F.pmod(weekday(ts) + 6, F.lit(7)) + 1).cast("string"),
        "U": lambda: two(F.floor((yday + 6 - weekday(ts)) / 7)), "W": lambda: two(F.floor((yday + 6 - F.pmod(weekday(ts) + 6, F.lit(7))) / 7)),
        "p": lambda: F.when(hour < 12, "AM").otherwise("PM"), "P": lambda: F.when(hour < 12, "am").otherwise("pm"),
        "R": lambda: F.date_format(ts, "HH:mm"), "T": lambda: F.date_format(ts, "HH:mm:ss"), "F": lambda: F.date_format(ts, "yyyy-MM-dd"),
        "f": lambda: F.date_format(ts, "ss.SSS"), "J": lambda: julianday(ts).cast("string"), "%": lambda: F.lit("%"),
    }
    parts = []
    for code, text in re.findall(r"%(.)|([^%]+)", pattern):
        parts.append(F.lit(text) if text else codes[code]())
    return F.concat(*parts)


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def datetime_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def date_trunc(field: str, ts: Column) -> Column:
    """date_trunc() with decade, century and millennium."""
    years = {"decade": 10, "century": 100, "millennium": 1000}
    if field in years:
        step = years[field]
        year = F.year(ts) - F.pmod(F.year(ts), F.lit(step)) if field == "decade" else F.year(ts) - 1 - F.pmod(F.year(ts) - 1, F.lit(step)) + 1
        return F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc(field, ts).cast("timestamp_ntz")


def timediff(a: Column, b: Column) -> Column:
    """Difference in whole days, as ±0000-00-DD 00:00:00.000."""
    days = F.datediff(a, b)
    return F.format_string("%s0000-00-%02d 00:00:00.000", F.when(days < 0, "-").otherwise("+"), F.abs(days))

"""Time arithmetic: differences in units, whole units, month formulas, slice bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"weeks": 604800, "days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}
#: Mean Gregorian year in seconds.
YEAR_SECONDS = 31556952
ALIASES = {
    "years": ("years", "year", "yr", "y"),
    "months": ("months", "month", "mon"),
    "weeks": ("weeks", "week", "w"),
    "days": ("days", "day", "d"),
    "hours": ("hours", "hour", "hr", "h"),
    "minutes": ("minutes", "minute", "min"),
    "seconds": ("seconds", "second", "sec", "s"),
}


def unit(name: str) -> str:
    """The unit of an alias; a bare "m" is refused as it may mean months or minutes."""
    low = name.strip().lower()
    for full, names in ALIASES.items():
        if low in names:
            return full
    raise ValueError(f"unknown unit {name!r}")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end with fractions; both naive timestamps or both dates."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(1e6)


def months_by_day(start: Column, end: Column) -> Column:
    """12 x years + months - [day of end <= day of start] + 1."""
    behind = (F.dayofmonth(end) <= F.dayofmonth(start)).cast("int")
    return 12 * (F.year(end) - F.year(start)) + (F.month(end) - F.month(start)) - behind + 1


def whole_months(start: Column, end: Column) -> Column:
    """Full calendar months from start to end, month ends clamped (31 January to 29 February is one)."""
    raw = 12 * (F.year(end) - F.year(start)) + F.month(end) - F.month(start)
    shifted = start.cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), raw)
    return raw - (shifted > end.cast("timestamp_ntz")).cast("int")


def whole_units(start: Column, end: Column, name: str) -> Column:
    """Completed units from start to end."""
    u = unit(name)
    if u == "months":
        return whole_months(start, end).cast("long")
    if u == "years":
        return F.floor(whole_months(start, end) / 12).cast("long")
    return F.floor(seconds_between(start, end) / SECONDS[u]).cast("long")


def order_units(start: Column, end: Column, name: str) -> Column:
    """1 for the last unit before end, 2 for the one before it."""
    return whole_units(start, end, name) + 1


def difference(start: Column, end: Column, name: str, rounding: str | None = None, y2k: bool = False) -> Column:
    """Difference in a unit; rounding none, "floor", "ceil" or "round" (half to even)."""
    u = unit(name)
    if y2k:
        start = fix_y2k(start, end)
    if u == "months":
        out = months_by_day(start, end).cast("double")
    else:
        out = seconds_between(start, end) / (YEAR_SECONDS if u == "years" else SECONDS[u])
    return {None: out, "floor": F.floor(out), "ceil": F.ceil(out), "round": F.bround(out)}[rounding]


def fix_y2k(date: Column, reference: Column, days: int = 36525) -> Column:
    """Dates after the reference are a century off."""
    return F.when(date > reference, date - F.make_dt_interval(F.lit(days))).otherwise(date)


def slice_bound(end: Column, k: Column | int, name: str) -> Column:
    """``end`` less k units."""
    u, k = unit(name), F.lit(k) if isinstance(k, int) else k
    if u == "months":
        return end - F.make_ym_interval(F.lit(0), k)
    if u == "years":
        return end - F.make_ym_interval(k, F.lit(0))
    parts = {"weeks": (k * 7,), "days": (k,), "hours": (F.lit(0), k), "minutes": (F.lit(0), F.lit(0), k), "seconds": (F.lit(0), F.lit(0), F.lit(0), k.cast("decimal(18,6)"))}
    return end - F.make_dt_interval(*parts[u])


def yyyymm(date: Column) -> Column:
    return (F.year(date) * 100 + F.month(date)).cast("int")

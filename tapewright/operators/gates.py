"""Rule gates: lists of named checks over a row, as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Checks = Sequence[tuple[str, Column]]


def errors(checks: Checks) -> Column:
    """Names of all checks that fail (a check that is unknown fails), in their order."""
    return F.filter(F.array(*(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in checks)), lambda x: x.isNotNull())


def first_failed(checks: Checks) -> Column:
    """Name of the first check that fails, null if all pass."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))


def cascade(df: DataFrame, checks: Checks, multipliers: Sequence[Column], base: float = 1.0) -> DataFrame:
    """``df`` with ``veto`` (first failed check) and ``size``: the product of the multipliers, 0 for vetoed rows."""
    size = F.lit(base)
    for m in multipliers:
        size = size * m
    return df.withColumn("veto", first_failed(checks)).withColumn("size", F.when(F.col("veto").isNull(), size).otherwise(0.0))


def in_ranges(ranges: Mapping[str, tuple[float | None, float | None]]) -> Checks:
    """Checks that columns lie within closed ranges; None is no bound."""
    out = []
    for name, (low, high) in ranges.items():
        ok = F.col(name).isNotNull()
        ok = ok if low is None else ok & (F.col(name) >= low)
        out.append((name, ok if high is None else ok & (F.col(name) <= high)))
    return out


NAMES = r"[A-Za-z_][A-Za-z_0-9]*"
#: Words that rule expressions may use besides columns.
RULE_WORDS = frozenset("and or not is null between in like true false".split())


def rule(df: DataFrame, expression: str) -> Column:
    """A user's boolean expression over the columns of ``df``; anything but columns, literals and comparisons is refused."""
    import re

    bare = re.sub(r"'[^']*'", " ", expression)
    calls = {w.lower() for w in re.findall(rf"({NAMES})\s*\(", bare)} - RULE_WORDS
    if calls or re.search(r"[^\w\s.<>=!()+\-*/%,]", bare):
        raise ValueError(f"not a rule: {expression}")
    unknown = {w for w in re.findall(NAMES, bare) if w.lower() not in RULE_WORDS and w not in df.columns}
    if unknown:
        raise ValueError(f"unknown names in the rule: {sorted(unknown)}")
    return F.expr(expression)


# --- time


def new_york(ts: Column) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), "America/New_York")


# Session windows in New York wall time (name, first and last minute, high probability).
SESSIONS = [("asian", "20:00", "23:59", False), ("london", "02:00", "05:00", True), ("new_york", "08:30", "11:00", True), ("london_close", "10:00", "12:00", False), ("lunch", "12:00", "13:30", False), ("afternoon", "13:30", "16:00", True)]


def session(ts: Column) -> Column:
    """Name of the first session window that holds the time, both ends included."""
    at = F.date_format(new_york(ts), "HH:mm")
    return F.coalesce(*(F.when((at >= a) & (at <= b), F.lit(n)) for n, a, b, _ in SESSIONS))


def tradeable(ts: Column) -> Column:
    """A session of high probability, and not lunch."""
    return F.coalesce(session(ts).isin(*(n for n, _, _, good in SESSIONS if good)), F.lit(False))


def regular_hours(ts: Column) -> Column:
    at = F.date_format(new_york(ts), "HH:mm")
    return (at >= "09:30") & (at < "16:00")


def market_open(ts: Column) -> Column:
    """Currency market: closed on Saturdays, before 21:00 on Sundays and from 21:00 on Fridays (UTC)."""
    day, hour = F.weekday(ts), F.hour(ts)
    return ~((day == 5) | ((day == 6) & (hour < 21)) | ((day == 4) & (hour >= 21)))

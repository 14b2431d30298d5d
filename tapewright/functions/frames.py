"""Window frames by symbol, with the warm-up rule that a value needs a full frame."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def BY() -> WindowSpec:  # noqa: N802  made when used: columns need a session
    return W.partitionBy("symbol").orderBy("bar_no")


def last(n: int, skip: int = 0) -> WindowSpec:
    """The frame of ``n`` rows that ends ``skip`` rows before the current one."""
    return BY().rowsBetween(-(n - 1) - skip, -skip)


def full(value: Column, of: str | Column, n: int, frame: WindowSpec) -> Column:
    """``value`` where the frame holds ``n`` non-null rows of ``of``, else null."""
    return F.when(F.count(of).over(frame) == n, value.over(frame))


def mean(x: str, n: int, skip: int = 0) -> Column:
    return full(F.avg(x), x, n, last(n, skip))


def std(x: str, n: int, skip: int = 0) -> Column:
    return full(F.stddev_samp(x), x, n, last(n, skip))


def std_pop(x: str, n: int) -> Column:
    return full(F.stddev_pop(x), x, n, last(n))


def total(x: str, n: int) -> Column:
    return full(F.sum(x), x, n, last(n))


def highest(x: str, n: int, skip: int = 0) -> Column:
    return full(F.max(x), x, n, last(n, skip))


def lowest(x: str, n: int, skip: int = 0) -> Column:
    return full(F.min(x), x, n, last(n, skip))


def prev(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(BY())


def ahead(x: str | Column, n: int = 1) -> Column:
    return F.lead(x, n).over(BY())


def running(x: Column) -> Column:
    return x.over(BY().rowsBetween(W.unboundedPreceding, 0))


def ratio(a: Column, b: Column) -> Column:
    """Division that gives null where there is nothing to divide by."""
    return a / F.nullif(b, F.lit(0.0))


def sign(up: Column, down: Column) -> Column:
    """1 if up, else -1 if down, else 0 (also where either is unknown)."""
    return F.when(up, 1).when(down, -1).otherwise(0)


def band(x: Column, low: float, high: float) -> Column:
    return sign(x > high, x < low)


def true_range() -> Column:
    """``greatest`` passes over the missing previous close of the first bar."""
    c = prev("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c), F.abs(F.col("low") - c))

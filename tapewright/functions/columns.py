"""The columns of bars, made when used: expressions need a running session, modules are imported without one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def O() -> Column:  # noqa: E743, N802
    return F.col("open")


def H() -> Column:  # noqa: N802
    return F.col("high")


def L() -> Column:  # noqa: N802
    return F.col("low")


def C() -> Column:  # noqa: N802
    return F.col("close")


def V() -> Column:  # noqa: N802
    return F.col("volume")


def TP() -> Column:  # noqa: N802
    """Typical price."""
    return (H() + L() + C()) / 3


def CLV() -> Column:  # noqa: N802
    """Where the close lies in the bar, from -1 to 1."""
    return ((C() - L()) - (H() - C())) / F.nullif(H() - L(), F.lit(0.0))

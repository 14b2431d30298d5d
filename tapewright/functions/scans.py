"""Recursive series that no window frame expresses, as one pass over a symbol's bars in order.

Each kernel gets a symbol's columns as arrays, so a symbol costs one group; nothing else is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Arrays = dict[str, np.ndarray]


def scan(df: DataFrame, kernel: Callable[[Arrays], Arrays], outputs: Sequence[str], inputs: Sequence[str], keys: Sequence[str] = ("symbol",), order: str = "bar_no") -> DataFrame:
    """``df``'s keys, order and ``inputs`` with the kernel's ``outputs`` (double; NaN becomes null)."""
    cols = [*keys, order, *inputs]
    schema = T.StructType([*(df.schema[c] for c in cols), *(T.StructField(o, T.DoubleType()) for o in outputs)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        made = kernel({c: frame[c].to_numpy(dtype=float) for c in inputs})
        extra = {o: pd.array(np.where(np.isnan(made[o]), 0.0, made[o]), dtype="Float64") for o in outputs}
        for o in outputs:
            extra[o][np.isnan(made[o])] = pd.NA
        return frame.assign(**extra)

    return df.select(*cols).groupBy(*keys).applyInPandas(run, schema)


def ewm(x: np.ndarray, alpha: float, adjust: bool = False, min_periods: int = 1) -> np.ndarray:
    """Exponentially weighted mean; missing values decay the weights before them."""
    out = np.full(len(x), np.nan)
    top = weight = 0.0
    seen = 0
    for i, v in enumerate(x):
        if not np.isnan(v):
            if not seen:
                top, weight = v, 1.0
            elif adjust:
                top, weight = v + (1 - alpha) * top, 1.0 + (1 - alpha) * weight
            else:
                old = (1 - alpha) * weight
                top, weight = (alpha * v + old * top) / (alpha + old), 1.0
            seen += 1
        elif seen:
            if adjust:
                top, weight = (1 - alpha) * top, (1 - alpha) * weight
            else:
                weight *= 1 - alpha
        if seen >= min_periods:
            out[i] = top / weight if adjust else top
    return out


def ema(x: np.ndarray, span: int) -> np.ndarray:
    return ewm(x, 2.0 / (span + 1))


def wilder(x: np.ndarray, n: int, adjust: bool = True) -> np.ndarray:
    return ewm(x, 1.0 / n, adjust, n)


def true_range(a: Arrays) -> np.ndarray:
    before = np.concatenate([[np.nan], a["close"][:-1]])
    return np.fmax(a["high"] - a["low"], np.fmax(abs(a["high"] - before), abs(a["low"] - before)))


def directional(a: Arrays, n: int = 14) -> Arrays:
    """Average directional index with both directional indicators, smoothed by Wilder's mean."""
    up, down = np.diff(a["high"], prepend=np.nan), -np.diff(a["low"], prepend=np.nan)
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    with np.errstate(all="ignore"):
        atr = wilder(true_range(a), n)
        pdi, mdi = 100 * wilder(plus, n) / atr, 100 * wilder(minus, n) / atr
        total = pdi + mdi
        dx = np.where(total == 0, np.nan, 100 * abs(pdi - mdi) / total)
    return {"adx": wilder(dx, n), "pdi": pdi, "mdi": mdi}


def supertrend(a: Arrays, n: int = 10, mult: float = 3.0) -> Arrays:
    """A trailing band that follows the trend and flips when the close passes it."""
    atr, mid = wilder(true_range(a), n), (a["high"] + a["low"]) / 2
    upper, lower, c = mid + mult * atr, mid - mult * atr, a["close"]
    line, side = np.full(len(c), np.nan), np.zeros(len(c))
    for i in range(1, len(c)):
        held = lower[i] if np.isnan(line[i - 1]) else line[i - 1]
        lo, hi = lower[i], upper[i]
        if not (lo > held or c[i - 1] < held):
            lo = held if held > lo else lo
        if not (hi < held or c[i - 1] > held):
            hi = held if held < hi else hi
        if c[i] > hi:
            line[i], side[i] = lo, 1
        elif c[i] < lo:
            line[i], side[i] = hi, -1
        else:
            line[i], side[i] = held, side[i - 1]
    return {"line": line, "side": side}


def parabolic(a: Arrays, first: float = 0.02, most: float = 0.2) -> Arrays:
    """Parabolic stop-and-reverse: the stop accelerates towards the extreme of the current swing."""
    h, lo = a["high"], a["low"]
    stop, side = np.full(len(h), np.nan), np.ones(len(h))
    at, extreme, speed, up = lo[0], h[0], first, True
    stop[0] = at
    for i in range(1, len(h)):
        at += speed * (extreme - at)
        j = max(i - 2, 0)
        at = min(at, lo[i - 1], lo[j]) if up else max(at, h[i - 1], h[j])
        if (lo[i] < at) if up else (h[i] > at):
            up, at, extreme, speed = not up, extreme, lo[i] if up else h[i], first
        elif (h[i] > extreme) if up else (lo[i] < extreme):
            extreme, speed = h[i] if up else lo[i], min(speed + first, most)
        stop[i], side[i] = at, 1 if up else -1
    return {"stop": stop, "side": side}

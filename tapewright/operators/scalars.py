"""Row-wise formulas of risk, sizing, options and macro scores as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the approximation of the normal distribution.
CDF_TERMS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def r_multiple(entry: Column, stop: Column, exit_: Column, direction: Column) -> Column:
    risk = F.abs(entry - stop)
    return F.when(risk == 0, 0.0).otherwise(F.round((exit_ - entry) / F.nullif(risk, F.lit(0.0)) * direction, 3))


def kelly(p: Column, win: Column, loss: Column, most: float = 0.25) -> Column:
    """Share of capital by win chance and payoff; none where the edge is negative or nothing was lost."""
    b = win / F.nullif(loss, F.lit(0.0))
    return F.coalesce(clip((p * b - (1 - p)) / F.nullif(b, F.lit(0.0)), 0.0, most), F.lit(0.0))


def hoeffding(p: Column, n: Column, confidence: float = 0.95) -> Column:
    """Lower bound of a win chance after ``n`` trades."""
    return clip(p - F.sqrt(F.log(F.lit(2 / (1 - confidence))) / (2 * n)), 0.0, 1.0)


def sample_complexity(epsilon: Column, confidence: float = 0.95) -> Column:
    return F.ceil(F.log(F.lit(2 / (1 - confidence))) / (2 * epsilon * epsilon))


def expected_value(p: Column, win: Column, loss: Column) -> tuple[Column, Column]:
    """Expected result and the win chance at which it is zero."""
    return p * win - (1 - p) * loss, loss / F.nullif(win + loss, F.lit(0.0))


def binary_entropy(p: Column) -> Column:
    inside = (p > 0) & (p < 1)
    return F.when(inside, -p * F.log2(F.when(inside, p)) - (1 - p) * F.log2(1 - F.when(inside, p))).otherwise(0.0)


def interpolate(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Straight lines between knots, flat beyond them."""
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(out)
    return F.when(x <= knots[0][0], float(knots[0][1])).otherwise(out)


def cosine(a: str, b: str) -> Column:
    """Similarity of two array columns; null where one of them is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def normal_cdf(x: Column) -> Column:
    """Error under 1e-7, by a polynomial in 1 / (1 + 0.2316419 |x|)."""
    k = 1 / (1 + 0.2316419 * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(CDF_TERMS):
        poly = (poly + c) * k
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """Error under 4.5e-4, by a rational function of sqrt(-2 ln p)."""
    # Fixed values of the approximation.
    c, d = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    z = t - (c[0] + c[1] * t + c[2] * t * t) / (1 + d[0] * t + d[1] * t * t + d[2] * t * t * t)
    return F.when(p < 0.5, -z).otherwise(z)


def black_scholes_call(s: Column, k: Column, t: Column, r: Column, sigma: Column) -> Column:
    d1 = (F.log(s / k) + (r + sigma * sigma / 2) * t) / (sigma * F.sqrt(t))
    return s * normal_cdf(d1) - k * F.exp(-r * t) * normal_cdf(d1 - sigma * F.sqrt(t))


def normal_cdf_of(x: np.ndarray) -> np.ndarray:
    """``normal_cdf`` of an array."""
    k = 1 / (1 + 0.2316419 * np.abs(x))
    poly = np.zeros_like(x)
    for c in reversed(CDF_TERMS):
        poly = (poly + c) * k
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return np.where(x >= 0, 1 - tail, tail)


def implied_volatility(price: Column, s: Column, k: Column, t: Column, r: Column, steps: int = 40, high: float = 5.0) -> Column:
    """Bisection on the call price, a fixed number of halvings of all rows of a batch at once; null where an input is null."""

    @F.pandas_udf("double")
    def halved(price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series) -> pd.Series:
        price, s, k, t, r = (x.to_numpy(dtype=float, na_value=np.nan) for x in (price, s, k, t, r))
        a, b = np.full(len(price), 1e-4), np.full(len(price), high)
        with np.errstate(all="ignore"):
            ratio, root, owed = np.log(s / k), np.sqrt(t), k * np.exp(-r * t)
            for _ in range(steps):
                mid = (a + b) / 2
                d1 = (ratio + (r + mid * mid / 2) * t) / (mid * root)
                below = s * normal_cdf_of(d1) - owed * normal_cdf_of(d1 - mid * root) < price
                a, b = np.where(below, mid, a), np.where(below, b, mid)
        return pd.Series((a + b) / 2)

    inputs = [x.cast("double") for x in (price, s, k, t, r)]
    known = inputs[0].isNotNull()
    for x in inputs[1:]:
        known = known & x.isNotNull()
    return F.when(known, halved(*inputs))


def deflated_sharpe(sharpe: Column, trials: Column, spread: Column, n: Column) -> tuple[Column, Column]:
    """The best Sharpe ratio to expect of so many trials by chance, and the chance that the observed one is above it."""
    gamma = 0.5772156649015329  # Euler's constant
    expected = spread * ((1 - gamma) * normal_quantile(1 - 1 / trials) + gamma * normal_quantile(1 - 1 / (trials * math.e)))
    return expected, normal_cdf((sharpe - expected) * F.sqrt(n - 1) / F.sqrt(1 + sharpe * sharpe / 2))


def opex(day: Column) -> Column:
    """Third Friday of the day's month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "month"), 1), "FRI"), 14)


def participation_impact(sigma: Column, quantity: Column, volume: Column, k: float = 0.1) -> Column:
    """Market impact that grows with the root of the share of volume."""
    return k * sigma * F.sqrt(quantity / F.nullif(volume, F.lit(0.0)))


def swap_days(days: Column) -> Column:
    """Nights that are charged: two more for each full five days."""
    return days + 2 * F.floor(days / 5)


def tighter_stop(entry: Column, direction: Column, by_range: Column, by_structure: Column) -> Column:
    return F.when(direction > 0, F.greatest(by_range, by_structure)).otherwise(F.least(by_range, by_structure))


def weighted_mean(pairs: Sequence[tuple[Column, float]]) -> Column:
    """Mean of the values that are there, by their weights."""
    top = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in pairs), F.lit(0.0))
    return top / F.nullif(sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in pairs), F.lit(0.0)), F.lit(0.0))


def ladder(x: Column, steps: Sequence[tuple[float, float]], other: float) -> Column:
    """The value of the first step whose bound is at or above ``x``."""
    out = F.lit(other)
    for bound, value in reversed(steps):
        out = F.when(x <= bound, F.lit(value)).otherwise(out)
    return out

"""Models fitted anew for every bar on the bars before it: all windows of a piece of a series at once.

A series is cut into pieces of ``piece`` bars, each with as many bars before it as a window needs, so a piece is a task of bounded
size and the work is in proportion to the series. In a piece the windows are rows of arrays, and every step of a
fit (a pass of expectation-maximisation, a step of least squares) is made for all of them together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fit = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def by_windows(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], window: int, fit: Fit, piece: int = 512, first: int | None = None, step: int = 1, key: str = "symbol", order: str = "bar_no") -> DataFrame:
    """(key, order, *outputs) for each ``step``-th bar from number ``first`` on (``window`` if not given).

    ``fit`` gets windows [row, bar, input], each ending with its bar, and how many bars each has: those of bars before number
    ``window`` begin with the first bar, and with NaN before it. Bars are numbered from 1 without gaps.
    """
    start = window if first is None else first
    out = T.StructType([df.schema[key], df.schema[order], *(T.StructField(o, T.DoubleType()) for o in outputs)])
    number = F.col(order).cast("long") - 1
    last = F.floor((number + window - 1) / piece)
    pieces = F.explode(F.sequence(F.floor(number / piece), last)).alias("_piece")
    rows = df.select(key, order, *inputs, pieces)

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        no, x = frame[order].to_numpy(np.int64), frame[list(inputs)].to_numpy(dtype=float)
        low = max(group[1] * piece + 1, start)
        bars = np.array([b for b in range(low, min(int(no[-1]), (group[1] + 1) * piece) + 1) if (b - start) % step == 0], np.int64)
        at = bars[:, None] - int(no[0]) + np.arange(1 - window, 1)
        taken = np.where((at >= 0)[:, :, None], x[np.maximum(at, 0)], np.nan)
        found = fit(taken, np.minimum(bars, window)) if len(bars) else dict.fromkeys(outputs, np.zeros(0))
        values = {o: np.asarray(found[o], dtype=float) for o in outputs}
        return frame.loc[np.isin(no, bars), [key, order]].assign(**{o: pd.arrays.FloatingArray(np.nan_to_num(v), np.isnan(v)) for o, v in values.items()})

    return rows.groupBy(key, "_piece").applyInPandas(run, out)


# --- regimes


@dataclass
class States:
    """Two states for each of many windows: means and variances [state, row, feature], chances of moves [from, to, row] and of the start [state, row]."""

    mean: np.ndarray
    var: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    def repeated(self, rows: int) -> States:
        return States(*(np.repeat(p, rows, axis=a) for p, a in ((self.mean, 1), (self.var, 1), (self.move, 2), (self.begin, 1))))


def densities(x: np.ndarray, s: States) -> np.ndarray:
    """Logarithms of the densities [bar, state, row] of x [bar, row, feature]."""
    return np.stack([-0.5 * ((x - s.mean[k]) ** 2 / s.var[k] + np.log(2 * np.pi * s.var[k])).sum(-1) for k in (0, 1)], 1)


def chances(x: np.ndarray, known: np.ndarray, s: States) -> tuple[np.ndarray, np.ndarray]:
    """Chances of the states at each bar [bar, state, row] and expected numbers of moves [from, to, row].

    ``known`` [bar, row] is false before a window's first bar.
    """
    logs = densities(x, s)
    like = np.where(known[:, None], np.exp(logs - logs.max(1, keepdims=True)), 1.0)
    m = s.move
    ahead, back = np.empty_like(like), np.empty_like(like)
    for i in range(len(x)):
        if i == 0:
            p = s.begin * like[0]
        else:
            a = ahead[i - 1]
            p = np.where(known[i - 1], a[0] * m[0] + a[1] * m[1], s.begin) * like[i]
        ahead[i] = p / (p[0] + p[1])
    moves = np.zeros_like(m)
    b = np.ones_like(s.begin)
    back[-1] = b
    for i in range(len(x) - 2, -1, -1):
        lb = like[i + 1] * b
        pair = ahead[i][:, None] * m * lb[None]
        moves += np.where(known[i], pair / pair.sum((0, 1)), 0.0)
        b = m[:, 0] * lb[0] + m[:, 1] * lb[1]
        b = b / (b[0] + b[1])
        back[i] = b
    chance = ahead * back
    return np.where(known[:, None], chance / chance.sum(1, keepdims=True), 0.0), moves


def estimated(x: np.ndarray, chance: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of the states, a variance being ``least`` at least."""
    weight = chance.sum(0)[..., None] + 1e-10
    mean = np.stack([(chance[:, k, :, None] * x).sum(0) for k in (0, 1)]) / weight
    return mean, np.maximum(np.stack([(chance[:, k, :, None] * (x - mean[k]) ** 2).sum(0) for k in (0, 1)]) / weight, least)


def fit_states(x: np.ndarray, known: np.ndarray, s: States, rounds: int, least: float = 1e-3) -> States:
    """Expectation-maximisation for all windows [bar, row, feature] together, from the given start."""
    first = known.argmax(0)
    for _ in range(rounds):
        chance, moves = chances(x, known, s)
        mean, var = estimated(x, chance, least)
        begin = np.take_along_axis(chance, first[None, None], 0)[0]
        s = States(mean, var, (moves + 1e-6) / (moves + 1e-6).sum(1, keepdims=True), begin)
    return s


def likeliest_last(x: np.ndarray, known: np.ndarray, s: States) -> np.ndarray:
    """The last state of each window's likeliest path."""
    logs = np.where(known[:, None], densities(x, s), 0.0)
    begin, move = np.log(s.begin + 1e-300), np.log(s.move + 1e-300)
    way = begin + logs[0]
    for i in range(1, len(x)):
        way = np.where(known[i - 1], (way[:, None] + move).max(0), begin) + logs[i]
    return way.argmax(0)


def regimes(rounds: int = 30, warm: int = 8) -> Fit:
    """``state`` (0 is the calmer one by the second feature, a move's size) and ``leave``, the chance of leaving it.

    Features are scaled by each window's deviations. The last window of a piece is fitted from its halves of small and large moves, in
    ``rounds`` passes; all begin with what it found, and take ``warm`` passes.
    """

    def fit(x: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
        x = x.transpose(1, 0, 2)
        known = ~np.isnan(x).all(-1)
        x = np.where(known[..., None], np.nan_to_num(x), np.nan)
        z = np.nan_to_num((x - np.nanmean(x, 0)) / np.maximum(np.nanstd(x, 0), 1e-12))
        one, own = z[:, -1:], known[:, -1:]
        wild = one[..., 1] > np.median(one[own][:, 1])
        mean, var = estimated(one, np.stack([~wild & own, wild & own], 1).astype(float), 1e-3)
        start = States(mean, var, np.array([[[0.9], [0.1]], [[0.1], [0.9]]]), np.full((2, 1), 0.5))
        s = fit_states(z, known, fit_states(one, own, start, rounds).repeated(z.shape[1]), warm)
        last = likeliest_last(z, known, s)
        rows = np.arange(z.shape[1])
        return {"state": (last != s.mean[:, :, 1].argmin(0)).astype(float), "leave": 1 - s.move[last, last, rows]}

    return fit


# --- growth

LOW, HIGH = np.array([0.001, 0.0, 0.5]), np.array([2.0, np.inf, 2.0])


def logistic_fits(y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Parameters (rate, middle, level) and r-square of a logistic curve through each row, by damped least squares within bounds.

    Rows are scaled to 0..1 first; the middle lies within the row, the rate from 0.001 to 2, the level from 0.5 to 2. A step that
    does not lower a row's squares is not taken and damps that row's next one. Rows without range have no numbers.
    """
    rows, n = y.shape
    t = np.arange(n, dtype=float)
    low, span = y.min(1, keepdims=True), np.ptp(y, axis=1)
    flat = ~(span >= 1e-10)
    v = (y - low) / np.where(flat, 1.0, span)[:, None]
    high = np.where(np.isinf(HIGH), n, HIGH)
    p = np.tile(np.array([0.1, n / 2, 1.0]), (rows, 1))
    damp = np.full(rows, 1e-2)

    def shape(p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-p[:, :1] * (t - p[:, 1:2]), -500, 500)))

    def squares(p: np.ndarray) -> np.ndarray:
        return ((p[:, 2:] * shape(p) - v) ** 2).sum(1)

    error = squares(p)
    for _ in range(rounds):
        s = shape(p)
        slope = p[:, 2:] * s * (1 - s)
        jac = np.stack([slope * (t - p[:, 1:2]), -slope * p[:, :1], s], -1)
        left = v - p[:, 2:] * s
        grad = np.einsum("rni,rn->ri", jac, left)
        # at a bound a parameter stays if the step leads outwards
        fixed = ((p <= LOW) & (grad < 0)) | ((p >= high) & (grad > 0))
        jac = np.where(fixed[:, None, :], 0.0, jac)
        hess = np.einsum("rni,rnj->rij", jac, jac)
        scale = np.maximum(np.einsum("rii->ri", hess), 1e-9)
        hess += np.eye(3) * np.where(fixed, 1.0, damp[:, None] * scale)[:, :, None]
        step = np.linalg.solve(hess, np.where(fixed, 0.0, grad)[..., None])[..., 0]
        new = np.clip(p + step, LOW, high)
        now = squares(new)
        better = now < error
        p = np.where(better[:, None], new, p)
        error = np.where(better, now, error)
        damp = np.clip(np.where(better, damp / 3, damp * 4), 1e-12, 1e12)
    total = ((v - v.mean(1, keepdims=True)) ** 2).sum(1)
    r2 = np.where(total > 0, 1 - error / np.where(total > 0, total, 1), 0.0)
    return np.where(flat[:, None], np.nan, p), np.where(flat, np.nan, r2)


def growth(good: float = 0.3) -> Fit:
    """``rate`` and ``r2`` of the logistic curve through each window; no rate where r2 is ``good`` or less, or a value is missing."""

    def fit(x: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
        y = x[:, :, 0]
        whole = ~np.isnan(y).any(1)
        rate, r2 = np.full(len(y), np.nan), np.full(len(y), np.nan)
        if whole.any():
            p, fitted = logistic_fits(y[whole])
            r2[whole] = fitted
            rate[whole] = np.where(fitted > good, p[:, 0], np.nan)
        return {"rate": rate, "r2": r2}

    return fit

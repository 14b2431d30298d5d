"""Trade simulation and account rules as keyed state machines, and resampling tests.

A machine's next step depends on the one before, so each series (a symbol under one set of parameters, an account) is
one group, folded in order by a small kernel; Spark deals the series out. Everything that is not a recursion (signals,
ranges, labels, excursions) is made by window expressions before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.sources.staging import staged

TRADES = "entry_bar long, exit_bar long, direction int, entry double, exit double, reason string"


def trades_of(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], kernel: Callable[..., list[tuple]], schema: str = TRADES, order: str = "bar_no") -> DataFrame:
    """The rows that ``kernel`` makes of each series; it gets the inputs as arrays, in order, and the key's values."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    out = T.StructType([*(df.schema[k] for k in keys), *fields])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        rows = kernel(frame[order].to_numpy(), *(frame[c].to_numpy(dtype=float) for c in inputs), **dict(zip(keys, key, strict=True)))
        made = pd.DataFrame(rows, columns=[f.name for f in fields])
        for k, v in zip(keys, key, strict=True):
            made[k] = v
        return made[[*keys, *(f.name for f in fields)]]

    return df.select(*keys, order, *inputs).groupBy(*keys).applyInPandas(run, out)


def bracket(stop_mult: float = 1.5, reward: float = 2.0, slip: float = 0.0005, gap: str = "open") -> Callable[..., list[tuple]]:
    """Entry at the close on a signal; stop before target; a gap past the stop fills at the open.

    With ``gap`` "best" it fills at the better of open and stop. The exit bar takes no new entry, and a trade that is
    still open at the end is dropped. ``stop_mult`` and ``reward`` may also come as keys of the series.
    """

    def kernel(bar, o, h, lo, c, signal, atr, stop_mult=stop_mult, reward=reward, **_) -> list[tuple]:
        out, side = [], 0
        for i in range(len(bar)):
            if side:
                at, why = None, "stop"
                if (o[i] - stop) * side <= 0:
                    at = o[i] if gap == "open" else max(o[i] * side, stop * side) * side
                elif ((lo[i] if side > 0 else h[i]) - stop) * side <= 0:
                    at = stop
                elif ((h[i] if side > 0 else lo[i]) - target) * side >= 0:
                    at, why = target, "target"
                if at is not None:
                    out.append((int(bar[start]), int(bar[i]), side, entry, at, why))
                    side = 0
            elif signal[i] and atr[i] > 0:
                side, start = int(signal[i]), i
                entry = c[i] * (1 + side * slip)
                stop, target = entry - side * stop_mult * atr[i], entry + side * reward * stop_mult * atr[i]
        return out

    return kernel


GRID_STATS = ("n", "wins", "total", "gain", "loss")


def bracket_grid(o, h, lo, c, signal, atr, stop_mult: np.ndarray, reward: np.ndarray, slip: float = 0.0005) -> dict[str, np.ndarray]:
    """The trades of ``bracket`` under many parameters at once, summed: one step over all of them for each bar."""
    side = np.zeros(len(stop_mult))
    entry, stop, target = np.ones_like(side), np.zeros_like(side), np.zeros_like(side)
    out = {k: np.zeros_like(side) for k in GRID_STATS}
    for i in range(len(o)):
        gone = None
        if side.any():
            worst, best = np.where(side > 0, lo[i], h[i]), np.where(side > 0, h[i], lo[i])
            gap, hit, won = ((x - y) * side <= 0 for x, y in ((o[i], stop), (worst, stop), (target, best)))
            gone = (side != 0) & (gap | hit | won)
            if gone.any():
                ret = np.where(gone, (np.where(gap, o[i], np.where(hit, stop, target)) / entry - 1) * side, 0.0)
                for k, x in (("n", gone), ("wins", ret > 0), ("total", ret), ("gain", np.maximum(ret, 0.0)), ("loss", -np.minimum(ret, 0.0))):
                    out[k] += x
        if signal[i] and atr[i] > 0:
            new, at = side == 0, c[i] * (1 + signal[i] * slip)
            side = np.where(new, signal[i], side)
            entry, stop, target = np.where(new, at, entry), np.where(new, at - signal[i] * stop_mult * atr[i], stop), np.where(new, at + signal[i] * reward * stop_mult * atr[i], target)
        if gone is not None:
            side = np.where(gone, 0.0, side)
    return out


def sweep(df: DataFrame, params: DataFrame, block: int = 500, key: str = "symbol", order: str = "bar_no") -> DataFrame:
    """(key, *params, n, wins, total, gain, loss) for each series under each (stop_mult, reward) that made a trade.

    ``params`` holds for all series, or with a column ``key`` each row for its own.

    A task gets a series once (its bars as arrays, bounded by its calendar) and a block of parameters, so bars are not
    multiplied by parameters; series and blocks are dealt over all tasks.
    """
    inputs = ["open", "high", "low", "close", "signal", "atr"]
    series = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *inputs))).alias("s")).select(key, *(F.transform(F.col(f"s.{x}"), lambda v: v.cast("double")).alias(x) for x in inputs))
    n = params.count()
    own = [key] if key in params.columns else []
    blocks = params.withColumn("_b", F.pmod(F.xxhash64("stop_mult", "reward"), F.lit(max(1, -(-n // block))))).groupBy(*own, "_b").agg(F.collect_list("stop_mult").alias("stop_mult"), F.collect_list("reward").alias("reward"))
    work = (series.join(F.broadcast(blocks), own) if own else series.join(F.broadcast(blocks))).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "_b")  # the blocks: n rows of two numbers, counted
    out = T.StructType([df.schema[key], *(T.StructField(c, T.DoubleType()) for c in ("stop_mult", "reward", *GRID_STATS))])

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                a = {c: np.asarray(getattr(row, c), dtype=float) for c in (*inputs, "stop_mult", "reward")}
                made = bracket_grid(*(a[c] for c in inputs), a["stop_mult"], a["reward"])
                yield pd.DataFrame({key: getattr(row, key), "stop_mult": a["stop_mult"], "reward": a["reward"], **made})

    return work.drop("_b").mapInPandas(run, out).where("n > 0")


def halving(df: DataFrame, params: DataFrame, parts: Sequence[float], keep: float = 1 / 4, key: str = "symbol", order: str = "bar_no") -> DataFrame:
    """(key, stop_mult, reward, total): the best parameters of each series, by successive halving.

    Every rung runs what is left on a larger part of each series' bars and keeps the share ``keep`` of the best totals, the last one the best
    alone (ties: the smaller stop, then the smaller reward). Between rungs there is one small table, the survivors.
    """
    ends = df.groupBy(key).agg(F.max(order).alias("_end"))
    series = df.join(ends, key)
    left = params if key in params.columns else ends.select(key).join(F.broadcast(params.select("stop_mult", "reward")))  # as many rows as backtests
    left = staged(left, "candidates")
    for i, part in enumerate(parts):
        made = sweep(series.where(F.col(order) <= F.col("_end") * part).drop("_end"), left.select(key, "stop_mult", "reward"), key=key, order=order)
        made = left.select(key, "stop_mult", "reward").join(made.select(key, "stop_mult", "reward", "total"), [key, "stop_mult", "reward"], "left").na.fill(0.0, ["total"])  # without a trade
        ranked = made.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("total"), "stop_mult", "reward"))).withColumn("_n", F.count("*").over(W.partitionBy(key)))
        last = i + 1 == len(parts)
        left = staged(ranked.where("_r = 1" if last else F.col("_r") <= F.ceil(F.col("_n") * keep)).select(key, "stop_mult", "reward", "total"), "survivors")
    return left


def close_based(hold: int = 12, stop_pct: float = 0.3, stop_mult: float = 2.0, trail_mult: float = 3.0) -> Callable[..., list[tuple]]:
    """Entry at the open after a signal; exits on closes: stop, trailing stop, reversed signal, then time."""

    def kernel(bar, o, c, signal, atr, **_) -> list[tuple]:
        out, side = [], 0
        for i in range(len(bar)):
            if side and i > start:
                best = max(best, c[i] * side)
                limit = min(stop_pct, stop_mult * (atr[start - 1] if atr[start - 1] > 0 else np.inf) / entry)
                why = None
                if (c[i] / entry - 1) * side <= -limit:
                    why = "stop"
                elif atr[i] > 0 and best - c[i] * side >= trail_mult * atr[i]:
                    why = "trail"
                elif signal[i] * side < 0:
                    why = "reversal"
                elif i - start >= hold:
                    why = "time"
                if why:
                    out.append((int(bar[start]), int(bar[i]), side, entry, c[i], why))
                    side = 0
                    continue
            if not side and i and signal[i - 1]:
                side, start, entry = int(signal[i - 1]), i, o[i]
                best = c[i] * side
        return out

    return kernel


UNIT_TRADES = "entry_bar long, exit_bar long, direction int, units int, entry double, exit double, reason string"


def trend_units(strict: bool = False, hold: int = 30, stop: float = 2.0, trail: float = 3.0, step: float = 0.5, most: int = 4, refresh: int = 20) -> Callable[..., list[tuple]]:
    """Units added as a trade goes its way: entry at the open after a signal, exits on closes, a mean entry over all units.

    Exits in order: stop, trailing stop, (``strict``) a close under the lowest of the ten before, for long trades, a signal against the trade, a
    signal for it after ``refresh`` bars, (not strict) ``hold`` bars. After the last but one and the one before it the signal is taken at
    once, after others the exit bar takes none. A unit is added for every ``step`` ranges gained since the last, up to ``most``.
    Distances are parts of the price, in ranges of the bar that sets them. ``open1`` is the next bar's open, ``low10`` the lowest of the ten closes before.
    """

    def kernel(bar, open1, c, signal, atr, low10, **_) -> list[tuple]:
        out, side = [], 0
        for i in range(len(bar)):
            now, part = int(signal[i]), max(atr[i] / c[i], 1e-6)
            why = None
            if side:
                held += 1
                best = max(best * side, c[i] * side) * side
                if (c[i] - floor) * side <= 0:
                    why = "stop"
                elif (c[i] - best * (1 - side * trail * part)) * side <= 0:
                    why = "trail"
                elif strict and side > 0 and c[i] < low10[i]:
                    why = "donchian"
                elif now * side < 0:
                    why = "reversal"
                elif now == side and held >= refresh:
                    why = "refresh"
                elif not strict and held >= hold:
                    why = "time"
                if why:
                    out.append((int(bar[start]), int(bar[i]), side, units, entry, c[i], why))
                    side = 0
                elif units < most and (c[i] - mark) * side >= 0:
                    entry, units = (entry * units + c[i]) / (units + 1), units + 1
                    mark = c[i] * (1 + side * step * part)
            if not side and now and why in (None, "reversal", "refresh") and not np.isnan(open1[i]):
                side, start, held, units, entry, best = now, i + 1, 0, 1, open1[i], open1[i]
                floor, mark = entry * (1 - side * stop * part), entry * (1 + side * step * part)
        return out

    return kernel


def two_targets(first: float = 1.0, second: float = 2.5, shock: float = 2.5, trail: float = 1.5, wait: int = 24, pain: float = 2.5) -> Callable[..., list[tuple]]:
    """A watched trade with two targets, risking one range from the signal's close.

    Exits in order: the stop; a bar wider than ``shock`` ranges whose close lies more than a range against the trade; the second target, once the
    first is met in the same bar or before. The first target moves the stop to the entry, and from then on it trails the best price by ``trail``
    ranges. Last, after ``wait`` bars, a trade that was ever ``pain`` ranges under water and never gained as much as it still risks.
    """

    def kernel(bar, h, lo, c, signal, atr, **_) -> list[tuple]:
        out, side = [], 0
        for i in range(len(bar)):
            if side:
                worst, good = (lo[i], h[i]) if side > 0 else (h[i], lo[i])
                best = max(best * side, good * side) * side
                gain, loss = max(gain, (good - entry) * side), max(loss, (entry - worst) * side)
                at = why = None
                if (worst - stop) * side <= 0:
                    at, why = stop, "stop"
                elif h[i] - lo[i] > shock * atr[i] and (entry - c[i]) * side > atr[i]:
                    at, why = c[i], "shock"
                else:
                    if (good - entry) * side >= first * risk:
                        met, stop = True, max(stop * side, entry * side) * side
                        if (good - entry) * side >= second * risk:
                            at, why = entry + side * second * risk, "target"
                    if why is None:
                        if met:
                            stop = max(stop * side, (best - side * trail * atr[i]) * side) * side
                        if i - start > wait and loss > pain * atr[i] and gain < abs(entry - stop):
                            at, why = c[i], "stagnation"
                if why:
                    out.append((int(bar[start]), int(bar[i]), side, entry, at, why))
                    side = 0
            elif signal[i] and atr[i] > 0:
                side, start, entry, risk, met = int(signal[i]), i, c[i], atr[i], False
                stop, best, gain, loss = entry - side * risk, entry, 0.0, 0.0
        return out

    return kernel


def limit_entry(wait: int = 6, cooldown: int = 4, first: float = 1.0, second: float = 2.0) -> Callable[..., list[tuple]]:
    """A limit order at half a range below (above) the signal's close that may fill for ``wait`` bars.

    Half goes at the first target and the stop moves to the entry; the rest goes at the second target or the stop,
    which is looked at first. After an exit no signal counts for ``cooldown`` bars. ``exit`` is the mean exit price.
    """

    def kernel(bar, h, lo, c, signal, atr, **_) -> list[tuple]:
        out, i, n = [], 0, len(bar)
        while i < n:
            side = int(signal[i])
            if not side or not atr[i] > 0:
                i += 1
                continue
            entry, risk = c[i] - side * 0.5 * atr[i], atr[i]
            fill = next((j for j in range(i + 1, min(i + wait, n - 1) + 1) if (lo[j] <= entry if side > 0 else h[j] >= entry)), None)
            if fill is None:
                i += 1
                continue
            stop, half, done = entry - side * risk, None, None
            for j in range(fill, n):
                worst, best = (lo[j], h[j]) if side > 0 else (h[j], lo[j])
                if (worst - stop) * side <= 0:
                    done = (j, stop if half is None else (half + stop) / 2, "stop" if half is None else "even")
                elif half is None and (best - entry) * side >= first * risk:
                    half, stop = entry + side * first * risk, entry
                elif half is not None and (best - entry) * side >= second * risk:
                    done = (j, (half + entry + side * second * risk) / 2, "target")
                if done:
                    break
            if not done:
                break
            out.append((int(bar[fill]), int(bar[done[0]]), side, entry, done[1], done[2]))
            i = done[0] + cooldown + 1
        return out

    return kernel


def managed(shock: float = 3.0, hold: int = 20) -> Callable[..., list[tuple]]:
    """A trade under watch: stop, then exit on a shock bar, half at one range (stop to entry), then a trailing stop, then time."""

    def kernel(bar, o, h, lo, c, signal, atr, **_) -> list[tuple]:
        out, side = [], 0
        for i in range(len(bar)):
            if side:
                worst, best = (lo[i], h[i]) if side > 0 else (h[i], lo[i])
                at = why = None
                if (worst - stop) * side <= 0:
                    at, why = stop, "stop" if not half else "trail"
                elif atr[i] > 0 and (o[i] - c[i]) * side >= shock * atr[i]:
                    at, why = c[i], "shock"
                elif i - start >= hold:
                    at, why = c[i], "time"
                if why:
                    out.append((int(bar[start]), int(bar[i]), side, entry, at, why))
                    side = 0
                    continue
                if not half and (best - entry) * side >= risk:
                    half, stop = True, entry
                if half:
                    stop = max(stop * side, (best - side * risk) * side) * side
            elif signal[i] and atr[i] > 0:
                side, start, entry, risk, half = int(signal[i]), i, c[i], atr[i], False
                stop = entry - side * risk
        return out

    return kernel


CHALLENGE = "days long, balance double, floor double, outcome string"


def challenge(account: float = 100_000.0, target: float = 0.08, trailing: float = 0.06, daily: float = 0.04) -> Callable[..., list[tuple]]:
    """Days of an account until it passes or breaks its rules.

    The floor follows the highest end-of-day balance until it reaches the start; a day's loss is limited too.
    """

    def kernel(day, pnl, **_) -> list[tuple]:
        balance = high = account
        floor = account * (1 - trailing)
        for i, x in enumerate(pnl):
            balance += x
            if x <= -daily * account or balance <= floor:
                return [(i + 1, balance, floor, "bust")]
            if balance >= account * (1 + target):
                return [(i + 1, balance, floor, "pass")]
            high = max(high, balance)
            floor = min(account, max(floor, high - trailing * account))
        return [(len(pnl), balance, floor, "open")]

    return kernel


def capped_challenge(account: float = 100_000.0, target: float = 0.08, trailing: float = 0.06, risk: float = 0.01, cap: float = 0.25) -> Callable[..., list[tuple]]:
    """Days of an account whose day's risk is ``risk`` of its start, or ``cap`` of what lies between balance and floor if that is less.

    A day's result is its sum of risk multiples times that; the floor follows the highest end-of-day balance until it reaches the start.
    """

    def kernel(day, multiples, **_) -> list[tuple]:
        balance = high = account
        floor = account * (1 - trailing)
        for i, x in enumerate(multiples):
            balance += x * min(risk * account, cap * (balance - floor))
            if balance <= floor:
                return [(i + 1, balance, floor, "bust")]
            if balance >= account * (1 + target):
                return [(i + 1, balance, floor, "pass")]
            high = max(high, balance)
            floor = min(account, max(floor, high - trailing * account))
        return [(len(multiples), balance, floor, "open")]

    return kernel


def draw(n: Column, *parts: Column | int | str) -> Column:
    """A number from 0 to n - 1 by a hash of ``parts``: the same on every run and every cluster."""
    text = F.concat_ws("/", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), n)


def resampled(df: DataFrame, value: str, by: str, sims: int, seed: int = 7) -> DataFrame:
    """(by, sim, step, value): ``sims`` bootstrap series of each group, as long as the group.

    Rows are numbered once by group; a draw is a number, and draws meet values by an equi-join on it.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(by)
    rows = df.select(by, (F.row_number().over(w.orderBy(value)) - 1).cast("long").alias("_at"), value, F.count("*").over(w).alias("_n"))
    draws = rows.select(by, F.col("_at").alias("step"), "_n", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim"))
    draws = draws.withColumn("_at", draw(F.col("_n"), seed, F.col(by), F.col("sim"), F.col("step")))
    return draws.join(rows.select(by, "_at", value), [by, "_at"]).select(by, "sim", "step", value)

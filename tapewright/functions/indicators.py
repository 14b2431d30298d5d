"""Technical indicators on bars: each adds ``raw`` (its value) and ``state`` (1, 0 or -1) to (symbol, bar_no).

Values are null until their frames are full. Indicators over recursive means take a frame from
``functions.scans``; all others are window expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import scans
from tapewright.functions.columns import CLV, TP, C, H, L, O, V
from tapewright.operators.metrics import correlation
from tapewright.functions.frames import BY, ahead, band, full, highest, last, lowest, mean, prev, ratio, running, sign, std, std_pop, total, true_range

Indicator = Callable[[DataFrame], DataFrame]
KEPT = "_kept"  # a column that indicators pass on


def done(df: DataFrame, raw: Column, state: Column) -> DataFrame:
    out = df.withColumn("_raw", raw)
    kept = [KEPT] if KEPT in df.columns else []
    return out.withColumn("_state", state).select("symbol", "bar_no", F.round("_raw", 6).alias("raw"), F.coalesce(F.col("_state"), F.lit(0)).cast("int").alias("state"), *kept)


def with_states(df: DataFrame, chosen: dict[str, Indicator]) -> DataFrame:
    """``df`` with a column of states for each indicator, all over one partitioning of the bars by symbol."""
    keys = ("symbol", "bar_no")
    for name, f in chosen.items():
        others = [c for c in df.columns if c not in keys]
        made = f(df.withColumn(KEPT, F.struct(*others)))
        df = made.select(*keys, f"{KEPT}.*", F.col("state").alias(name))
    return df


def RAW() -> Column:  # noqa: N802
    return F.col("_raw")


def sma(df: DataFrame, n: int = 20) -> DataFrame:
    return done(df, mean("close", n), band(C() - mean("close", n), 0, 0))


def tr(df: DataFrame) -> DataFrame:
    return done(df, true_range(), F.lit(0))


def atr_sma(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range, where short a floor of one basis point of the close."""
    df = df.withColumn("tr", true_range())
    return done(df, F.coalesce(mean("tr", n), F.greatest(C() * 1e-4, F.lit(1e-9))), F.lit(0))


def rsi_value(df: DataFrame, n: int) -> DataFrame:
    d = F.col("close") - prev("close")
    df = df.withColumn("gain", F.when(d > 0, d).otherwise(0.0)).withColumn("loss", F.when(d < 0, -d).otherwise(0.0))
    return df.withColumn("rsi", 100 - 100 / (1 + ratio(mean("gain", n), mean("loss", n))))


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    return done(rsi_value(df, n), F.col("rsi"), band(RAW(), 40, 60))


def rsi_default(df: DataFrame, n: int = 14) -> DataFrame:
    """Like ``rsi``, but 50 while history is short and 100 without losses."""
    out = rsi_value(df, n)
    return done(out, F.when(F.col("bar_no") <= n, 50.0).when(mean("loss", n) == 0, 100.0).otherwise(F.col("rsi")), band(RAW(), 40, 60))


def stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    lo = lowest("low", k)
    df = df.withColumn("k", 100 * ratio(C() - lo, highest("high", k) - lo))
    df = df.withColumn("d", mean("k", d))
    up = (F.col("k") > 50) & (F.col("d") > 50) & (F.col("k") > F.col("d"))
    down = (F.col("k") < 50) & (F.col("d") < 50) & (F.col("k") < F.col("d"))
    return done(df, F.col("k"), sign(up, down))


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn("tp", TP()).withColumn("m", mean("tp", n)).withColumn("tps", F.collect_list("tp").over(last(n)))
    mad = F.aggregate("tps", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("m"))) / n
    return done(df, ratio(F.col("tp") - F.col("m"), 0.015 * mad), band(RAW(), -100, 100))


def williams(df: DataFrame, n: int = 14) -> DataFrame:
    hh, ll = highest("high", n), lowest("low", n)
    return done(df, -100 * ratio(hh - C(), hh - ll), band(RAW(), -80, -20))


def roc(df: DataFrame, n: int = 10) -> DataFrame:
    return done(df, (C() - prev("close", n)) / prev("close", n) * 100, band(RAW(), -0.5, 0.5))


def mfi(df: DataFrame, n: int = 14) -> DataFrame:
    df = df.withColumn("tp", TP())
    flow, before = F.col("tp") * V(), prev("tp")
    df = df.withColumn("pos", F.when(F.col("tp") > before, flow).otherwise(0.0)).withColumn("neg", F.when(F.col("tp") < before, flow).otherwise(0.0))
    return done(df, 100 - 100 / (1 + ratio(total("pos", n), total("neg", n))), band(RAW(), 40, 60))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, population: bool = False) -> DataFrame:
    s = std_pop("close", n) if population else std("close", n)
    low = mean("close", n) - k * s
    return done(df, ratio(C() - low, 2 * k * s), band(RAW(), 0.2, 0.8))


def donchian(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn("mid", (highest("high", n) + lowest("low", n)) / 2)
    return done(df, F.col("mid"), band((C() - F.col("mid")) / F.col("mid"), -0.001, 0.001))


def hist_vol(df: DataFrame, n: int = 20, high: float = 0.12) -> DataFrame:
    """Annualised deviation of log returns; a direction only while it is low."""
    df = df.withColumn("lr", F.log(C() / prev("close")))
    move = (C() - prev("close", n - 1)) / prev("close", n - 1)
    return done(df, std("lr", n) * math.sqrt(252), F.when(RAW() <= high, band(move, -0.005, 0.005)).otherwise(0))


def vol_trend(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn("up", C() > prev("close"))
    loud = RAW() > 1.5
    return done(df, ratio(V() - mean("volume", n), std("volume", n)), sign(loud & F.col("up"), loud & ~F.col("up")))


def volume_z(df: DataFrame, n: int = 20) -> DataFrame:
    return done(df, F.coalesce(ratio(V() - mean("volume", n), std("volume", n)), F.lit(0.0)), F.lit(0))


def with_vwap(df: DataFrame, n: int) -> DataFrame:
    df = df.withColumn("v0", F.nullif(V(), F.lit(0.0))).withColumn("tpv", TP() * F.col("v0"))
    return df.withColumn("vwap", total("tpv", n) / total("v0", n))


def vwap_ratio(df: DataFrame, n: int = 20) -> DataFrame:
    return done(with_vwap(df, n), ratio(C(), F.col("vwap")), band(RAW(), 0.999, 1.001))


def vwap_dev(df: DataFrame, n: int = 20) -> DataFrame:
    df = with_vwap(df, n)
    return done(df, ratio(C() - F.col("vwap"), std("vwap", n)), band(RAW(), -1, 1))


def cmf(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn("clv_v", CLV() * V())
    return done(df, ratio(total("clv_v", n), total("volume", n)), band(RAW(), -0.05, 0.05))


def ichimoku(df: DataFrame, tenkan: int = 9, kijun: int = 26, senkou: int = 52) -> DataFrame:
    mid = lambda n: (highest("high", n) + lowest("low", n)) / 2
    df = df.withColumn("a0", (mid(tenkan) + mid(kijun)) / 2).withColumn("b0", mid(senkou))
    a, b = F.coalesce(prev("a0", kijun), C()), F.coalesce(prev("b0", kijun), C())
    enough = F.col("bar_no") >= senkou
    df = df.withColumn("top", F.greatest(a, b)).withColumn("bottom", F.least(a, b))
    return done(df, F.when(enough, F.col("top")), sign(enough & (C() > F.col("top")), enough & (C() < F.col("bottom"))))


def aroon(df: DataFrame, n: int = 25) -> DataFrame:
    """Oscillator from how late in the frame its first high and first low came."""
    frame = last(n + 1)
    where = lambda x, best: (F.array_position(F.collect_list(x).over(frame), best(x).over(frame)) - 1).cast("double")
    df = df.withColumn("hi", where("high", F.max)).withColumn("lo", where("low", F.min))
    osc = (n - F.col("hi")) / n * 100 - (n - F.col("lo")) / n * 100
    return done(df, F.when(F.col("bar_no") > n, osc), band(RAW(), -50, 50))


def gap_state(df: DataFrame, look: int = 10) -> DataFrame:
    """The latest three-bar gap of the last ``look`` bars."""
    df = df.withColumn("gap", F.when(L() > prev("high", 2), 1).when(H() < prev("low", 2), -1))
    return done(df, F.last("gap", ignorenulls=True).over(last(look)).cast("double"), F.coalesce(RAW(), F.lit(0.0)).cast("int"))


def break_of_structure(df: DataFrame, n: int = 10) -> DataFrame:
    hi, lo = F.max("high").over(last(n, 5)), F.min("low").over(last(n, 5))
    df = df.withColumn("hi", hi).withColumn("lo", lo)
    enough = F.col("bar_no") >= 2 * n
    return done(df, F.when(enough, F.col("hi")), sign(enough & (C() > F.col("hi")), enough & (C() < F.col("lo"))))


def session_range(df: DataFrame, n: int = 5) -> DataFrame:
    df = df.withColumn("hi", F.max("high").over(last(5, 5))).withColumn("lo", F.min("low").over(last(5, 5)))
    enough = F.col("bar_no") >= n + 5
    return done(df, F.when(enough, F.col("hi")), sign(enough & (C() > F.col("hi")), enough & (C() < F.col("lo"))))


def sweep_state(df: DataFrame, look: int = 10, confirm: int = 3) -> DataFrame:
    """Recent bars passed the earlier extreme and the close is back inside."""
    k = confirm + 2
    df = df.withColumn("hi", F.max("high").over(last(look, k))).withColumn("lo", F.min("low").over(last(look, k)))
    df = df.withColumn("rh", F.max("high").over(last(k))).withColumn("rl", F.min("low").over(last(k)))
    enough = F.col("bar_no") >= look + k
    high, low = (F.col("rh") > F.col("hi")) & (C() < F.col("hi")), (F.col("rl") < F.col("lo")) & (C() > F.col("lo"))
    return done(df, F.when(enough, F.col("hi")), F.when(enough, F.when(high, -1).when(low, 1)))


def order_block_state(df: DataFrame, look: int = 20) -> DataFrame:
    """The close broke the earlier range and trades inside the last opposite candle before that."""
    hi, lo = F.max("high").over(last(look - 5, 5)), F.min("low").over(last(look - 5, 5))
    at = last(look - 5, 4)
    candle = F.struct("high", "low")
    df = df.withColumn("hi", hi).withColumn("lo", lo)
    df = df.withColumn("down", F.last(F.when(C() < O(), candle), ignorenulls=True).over(at)).withColumn("up", F.last(F.when(C() > O(), candle), ignorenulls=True).over(at))
    enough = F.col("bar_no") >= look + 5
    bull = enough & (C() > F.col("hi")) & (F.col("down.low") < C()) & (F.col("down.high") * 1.002 > C())
    bear = enough & (C() < F.col("lo")) & (F.col("up.low") * 0.998 < C()) & (F.col("up.high") > C())
    return done(df, F.when(enough, F.col("hi")), sign(bull, bear))


def obv(df: DataFrame) -> DataFrame:
    d = F.col("close") - prev("close")
    df = df.withColumn("sv", F.when(d > 0, V()).when(d < 0, -V()).otherwise(0.0))
    return done(df, running(F.sum("sv")), F.lit(0))


def acc_dist(df: DataFrame) -> DataFrame:
    return done(df.withColumn("x", CLV() * V()), running(F.sum("x")), F.lit(0))


# --- over recursive means


def _scanned(df: DataFrame, kernel: scans.Callable, outputs: list[str], inputs: list[str]) -> DataFrame:
    return scans.scan(df, kernel, outputs, inputs)


def ema(df: DataFrame, span: int = 20) -> DataFrame:
    return done(_scanned(df, lambda a: {"e": scans.ema(a["close"], span)}, ["e"], ["close"]), F.col("e"), band(C() - F.col("e"), 0, 0))


def ema_adjusted(df: DataFrame, span: int = 20) -> DataFrame:
    return done(_scanned(df, lambda a: {"e": scans.ewm(a["close"], 2 / (span + 1), adjust=True)}, ["e"], ["close"]), F.col("e"), F.lit(0))


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    return done(_scanned(df, lambda a: {"e": scans.wilder(scans.true_range(a), n)}, ["e"], ["high", "low", "close"]), F.col("e"), F.lit(0))


def rsi_wilder(df: DataFrame, n: int = 14) -> DataFrame:
    def kernel(a: scans.Arrays) -> scans.Arrays:
        import numpy as np

        d = np.diff(a["close"], prepend=np.nan)
        gain, loss = scans.ewm(np.where(d > 0, d, np.where(np.isnan(d), np.nan, 0.0)), 1 / n), scans.ewm(np.where(d < 0, -d, np.where(np.isnan(d), np.nan, 0.0)), 1 / n)
        with np.errstate(all="ignore"):
            return {"e": np.where(loss == 0, np.nan, 100 - 100 / (1 + gain / loss))}

    return done(_scanned(df, kernel, ["e"], ["close"]), F.col("e"), band(RAW(), 40, 60))


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    out = _scanned(df, lambda a: scans.directional(a, n), ["adx", "pdi", "mdi"], ["high", "low", "close"])
    return done(out, F.col("adx"), F.when(RAW() >= 20, F.when(F.col("pdi") > F.col("mdi"), 1).otherwise(-1)).otherwise(0))


def ema_cross(df: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    out = _scanned(df, lambda a: {"f": scans.ema(a["close"], fast), "s": scans.ema(a["close"], slow)}, ["f", "s"], ["close"])
    return done(out, (F.col("f") - F.col("s")) / F.col("s") * 100, F.when(F.abs(RAW()) < 0.05, 0).otherwise(band(RAW(), 0, 0)))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    def kernel(a: scans.Arrays) -> scans.Arrays:
        line = scans.ema(a["close"], fast) - scans.ema(a["close"], slow)
        return {"h": line - scans.ema(line, signal)}

    out = _scanned(df, kernel, ["h"], ["close"])
    before = F.coalesce(prev("h"), F.col("h"))
    out = out.withColumn("rising", F.col("h") > before)
    return done(out, F.col("h"), sign((RAW() > 0) & F.col("rising"), (RAW() < 0) & ~F.col("rising")))


def keltner(df: DataFrame, span: int = 20, k: float = 2.0) -> DataFrame:
    out = _scanned(df, lambda a: {"m": scans.ema(a["close"], span), "t": scans.wilder(scans.true_range(a), 14)}, ["m", "t"], ["high", "low", "close"])
    return done(out, ratio(C() - F.col("m"), k * F.col("t")), band(RAW(), -1, 1))


def atr_ratio(df: DataFrame, n: int = 14, look: int = 90) -> DataFrame:
    out = _scanned(df, lambda a: {"t": scans.wilder(scans.true_range(a), n)}, ["t"], ["high", "low", "close"]).withColumn("p", F.col("t") / C())
    return done(out, ratio(F.col("p") - mean("p", look), std("p", look)), F.lit(0))


def displacement(df: DataFrame, k: float = 2.0) -> DataFrame:
    out = _scanned(df, lambda a: {"t": scans.wilder(scans.true_range(a), 14)}, ["t"], ["open", "high", "low", "close"])
    far = (F.col("bar_no") >= 20) & (RAW() >= k)
    return done(out, ratio(F.abs(C() - O()), F.col("t")), F.when(far, F.when(C() > O(), 1).otherwise(-1)))


def slope_of(df: DataFrame, flow: Column, n: int) -> DataFrame:
    """Direction of a running sum's smoothed line over ``n`` bars."""
    df = df.withColumn("x", flow).withColumn("x", running(F.sum("x")))
    out = _scanned(df, lambda a: {"e": scans.ema(a["x"], n)}, ["e"], ["x"])
    return done(out, F.col("e") - prev("e", n - 1), band(RAW(), 0, 0))


def obv_slope(df: DataFrame, n: int = 20) -> DataFrame:
    d = F.col("close") - prev("close")
    return slope_of(df, F.when(d > 0, V()).when(d < 0, -V()).otherwise(0.0), n)


def acc_dist_slope(df: DataFrame, n: int = 20) -> DataFrame:
    return slope_of(df, CLV() * V(), n)


def supertrend(df: DataFrame, n: int = 10, k: float = 3.0) -> DataFrame:
    out = _scanned(df, lambda a: scans.supertrend(a, n, k), ["line", "side"], ["high", "low", "close"])
    return done(out, F.col("line"), F.col("side"))


def parabolic_sar(df: DataFrame) -> DataFrame:
    out = _scanned(df, scans.parabolic, ["stop", "side"], ["high", "low"])
    return done(out, F.col("stop"), F.col("side"))


# --- features without a state


def returns(df: DataFrame, n: int = 5) -> DataFrame:
    return done(df, F.coalesce(C() / prev("close", n) - 1, F.lit(0.0)), F.lit(0))


def legacy_return(df: DataFrame, n: int = 4) -> DataFrame:
    """Change over the *current* close."""
    return done(df, (C() - prev("close", n)) / C(), F.lit(0))


def adx_sma(df: DataFrame, n: int = 14) -> DataFrame:
    """Directional index from plain means: movements are positive parts, the smaller one is set to zero in turn."""
    up, down = H() - prev("high"), prev("low") - L()
    p, m = F.greatest(up, F.lit(0.0)), F.greatest(down, F.lit(0.0))
    df = df.withColumn("p0", p).withColumn("m0", m).withColumn("tr", true_range())
    df = df.withColumn("p", F.when(F.col("p0") < F.col("m0"), 0.0).otherwise(F.col("p0")))
    df = df.withColumn("m", F.when(F.col("m0") < F.col("p"), 0.0).otherwise(F.col("m0")))
    t = mean("tr", n)
    df = df.withColumn("pi", 100 * ratio(mean("p", n), t)).withColumn("mi", 100 * ratio(mean("m", n), t))
    df = df.withColumn("dx", 100 * ratio(F.abs(F.col("pi") - F.col("mi")), F.col("pi") + F.col("mi")))
    return done(df, mean("dx", n), sign(F.col("pi") > F.col("mi"), F.col("pi") < F.col("mi")))


def momentum_12_1(df: DataFrame, near: int = 21, far: int = 252) -> DataFrame:
    return done(df, prev("close", near) / prev("close", far) - 1, F.lit(0))


def flow_autocorr(df: DataFrame, n: int = 20) -> DataFrame:
    """Lag-one autocorrelation of signed volume within each frame."""
    df = df.withColumn("f", F.signum(C() - O()) * V())
    df = df.withColumn("g", prev("f"))
    inside = last(n - 1)
    return done(df, F.when(F.col("bar_no") >= n, correlation("f", "g", inside)), F.lit(0))


def entropy(df: DataFrame, n: int = 20, bins: int = 10) -> DataFrame:
    """Shannon entropy in bits of a frame's closes over ten equal bins."""
    df = df.withColumn("xs", F.collect_list("close").over(last(n))).withColumn("lo", lowest("close", n)).withColumn("hi", highest("close", n))
    at = lambda x: F.least(F.floor((x - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    df = df.withColumn("bs", F.transform("xs", at))
    share = lambda b: F.size(F.filter("bs", lambda y: y == b)) / n
    bits = F.aggregate(F.array_distinct("bs"), F.lit(0.0), lambda s, b: s - share(b) * F.log2(share(b)))
    return done(df, F.when(F.col("hi") > F.col("lo"), bits).when(F.col("hi") == F.col("lo"), 0.0), F.lit(0))


def hurst_ratio(df: DataFrame, n: int = 40) -> DataFrame:
    """Half plus half the log of two-step variance over twice the one-step variance, from 0.1 to 0.9."""
    df = df.withColumn("r1", F.log(C() / prev("close"))).withColumn("r2", F.log(C() / prev("close", 2)))
    v1, v2 = full(F.var_pop("r1"), "r1", n, last(n)), full(F.var_pop("r2"), "r2", n, last(n))
    h = 0.5 + 0.5 * F.log2(ratio(v2, 2 * v1))
    return done(df, F.least(F.greatest(h, F.lit(0.1)), F.lit(0.9)), sign(RAW() > 0.52, RAW() < 0.45))


def hurst_rescaled(df: DataFrame, n: int = 32) -> DataFrame:
    """Rescaled range of log returns: log(R / S) / log(n), 0.5 where they do not vary."""
    df = df.withColumn("lr", F.log(C() / prev("close")))
    df = df.withColumn("xs", F.when(F.count("lr").over(last(n)) == n, F.collect_list("lr").over(last(n)))).withColumn("m", F.avg("lr").over(last(n))).withColumn("s", F.stddev_pop("lr").over(last(n)))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo"))
    step = lambda a, x: F.struct((a["c"] + x - F.col("m")).alias("c"), F.greatest(a["hi"], a["c"] + x - F.col("m")).alias("hi"), F.least(a["lo"], a["c"] + x - F.col("m")).alias("lo"))
    df = df.withColumn("spread", F.aggregate("xs", start, step, lambda a: a["hi"] - a["lo"]))
    return done(df, F.when(F.col("spread").isNull(), None).when((F.col("s") > 0) & (F.col("spread") > 0), F.log(F.col("spread") / F.col("s")) / math.log(n)).otherwise(0.5), F.lit(0))


def vol_percentile(df: DataFrame, n: int = 100) -> DataFrame:
    """Share of the ``n`` earlier ranges that lie below the current one."""
    df = df.withColumn("rng", (H() - L()) / C()).withColumn("xs", F.when(F.count("close").over(last(n, 1)) == n, F.collect_list((H() - L()) / C()).over(last(n, 1))))
    return done(df, F.size(F.filter("xs", lambda x: x < F.col("rng"))) / F.when(F.col("xs").isNotNull(), F.size("xs")), F.lit(0))


def rolling_z(df: DataFrame, n: int = 60, least: int = 30) -> DataFrame:
    """Standard score over up to ``n`` bars once ``least`` are there."""
    enough = F.count("close").over(last(n)) >= least
    return done(df, F.when(enough, ratio(C() - F.avg("close").over(last(n)), F.stddev_samp("close").over(last(n)))), band(RAW(), -2, 2))


def range_index(df: DataFrame, n: int = 60) -> DataFrame:
    lo = lowest("close", n)
    return done(df, 100 * ratio(C() - lo, highest("close", n) - lo), band(RAW(), 20, 80))


def pct_rank(df: DataFrame, n: int = 60) -> DataFrame:
    """Share of the frame at or below the current close."""
    df = df.withColumn("xs", F.collect_list("close").over(last(n)))
    return done(df, F.when(F.col("bar_no") >= n, F.size(F.filter("xs", lambda x: x <= C())) / n), F.lit(0))


def rolling_sharpe(df: DataFrame, n: int = 30) -> DataFrame:
    df = df.withColumn("r", C() / prev("close") - 1)
    return done(df, ratio(mean("r", n), std_pop("r", n)) * math.sqrt(252), F.lit(0))


def drawdown(df: DataFrame) -> DataFrame:
    """Percent below the running peak; ``state`` holds bars since that peak first came."""
    peak = F.struct(F.col("close"), -F.col("bar_no"))
    best = F.max(peak).over(BY().rowsBetween(-(10**9), 0))
    df = df.withColumn("peak", best["close"]).withColumn("at", -best["col2"])
    return done(df, (C() - F.col("peak")) / F.col("peak") * 100, F.col("bar_no") - F.col("at"))


def range_position(df: DataFrame, n: int = 20) -> DataFrame:
    """Place in the last range: below half is a discount, above a premium."""
    lo = lowest("low", n)
    return done(df, ratio(C() - lo, highest("high", n) - lo), sign(RAW() < 0.5, RAW() > 0.5))


def swing_points(df: DataFrame, n: int = 3) -> DataFrame:
    """Centred extremes: 1 for a swing high, -1 for a low; needs ``n`` later bars (an offline feature)."""
    around = BY().rowsBetween(-n, n)
    whole = F.count("close").over(around) == 2 * n + 1
    return done(df, F.when(whole, F.max("high").over(around)), F.when(whole & (H() == F.max("high").over(around)), 1).when(whole & (L() == F.min("low").over(around)), -1))


def vol_slope(df: DataFrame, n: int = 6) -> DataFrame:
    """Least-squares slope of the range over its mean: expanding, contracting or stable."""
    df = df.withColumn("rng", H() - L())
    s = F.regr_slope("rng", "bar_no").over(last(n))
    return done(df, F.when(F.col("bar_no") >= n, ratio(s, F.avg("rng").over(last(n)))), band(RAW(), -0.02, 0.02))


def donchian_entry(df: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    """Close beyond the earlier extremes of both lengths, on one side only."""
    up = (C() > highest("close", fast, 1)) & (C() > highest("close", slow, 1))
    down = (C() < lowest("close", fast, 1)) & (C() < lowest("close", slow, 1))
    return done(df, highest("close", slow, 1), sign(up, down))


def forward_return_label(df: DataFrame, n: int = 4, bp: float = 10) -> DataFrame:
    """1 if the close ``n`` bars on is more than ``bp`` basis points higher; unknown futures are 0."""
    return done(df, ahead("close", n) / C() - 1, (RAW() > bp / 1e4).cast("int"))


def trapped(df: DataFrame, n: int = 10) -> DataFrame:
    """Closes two percent off their mean; pressure grows with the distance up to 0.8."""
    df = df.withColumn("d", (C() - mean("close", n)) / mean("close", n))
    return done(df, F.least(5 * F.abs("d"), F.lit(0.8)), sign(F.col("d") < -0.02, F.col("d") > 0.02))


def sweep_events(df: DataFrame, n: int = 20, wick: float = 0.3) -> DataFrame:
    """Lows under the earlier range that closed back inside, and highs above it, with a wick of 0.3 ATR (the symbol's last)."""
    df = df.withColumn("tr", true_range())
    df = df.withColumn("atr", mean("tr", 14))
    df = df.withColumn("atr", F.last("atr", ignorenulls=True).over(BY().rowsBetween(-(10**9), 10**9)))
    lo, hi = lowest("low", n, 1), highest("high", n, 1)
    bull = (L() < lo) & (C() > lo) & (lo - L() >= wick * F.col("atr"))
    bear = (H() > hi) & (C() < hi) & (H() - hi >= wick * F.col("atr"))
    later = ahead("close", 3)
    out = df.withColumn("side", F.when(bull, 1).when(bear, -1).otherwise(0))
    return done(out.withColumn("turn", F.when(F.col("side") == 1, later > C()).when(F.col("side") == -1, later < C())), F.col("turn").cast("double"), F.col("side"))


def gap_events(df: DataFrame, least: float = 0.3) -> DataFrame:
    """Three-bar gaps of at least 0.3 ATR, their size in ``raw``."""
    df = df.withColumn("tr", true_range())
    df = df.withColumn("atr", mean("tr", 14))
    up, down = L() - prev("high", 2), prev("low", 2) - H()
    size = F.when(up > 0, up).when(down > 0, down)
    big = size >= least * F.col("atr")
    return done(df, F.when(big, size), F.when(big, F.when(up > 0, 1).otherwise(-1)))


def order_blocks(df: DataFrame, k: float = 1.5) -> DataFrame:
    """A candle before a move of 1.5 ATR the other way within the next bar."""
    df = df.withColumn("tr", true_range())
    df = df.withColumn("atr", mean("tr", 14))
    move = ahead("close") - ahead("open")
    bull = (C() < O()) & (move >= k * F.col("atr"))
    bear = (C() > O()) & (-move >= k * F.col("atr"))
    return done(df, F.when(bull | bear, F.abs(move)), sign(bull, bear))

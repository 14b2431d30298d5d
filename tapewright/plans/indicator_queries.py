"""Indicator queries over hourly bars, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewright.functions import indicators as ind
from tapewright.plans.sql import BARS, BY, band, ewm_cte, full, lag, steps, w, wilder_cte
from tapewright.sources.market import bars


def _over_bars(f: ind.Indicator) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(bars(spark, sf_dir))


FUNCTIONS: dict[str, ind.Indicator] = {
    "f01_true_range": ind.tr,
    "f02_sma": ind.sma,
    "f03_ema": ind.ema,
    "f04_ema_adjusted": ind.ema_adjusted,
    "f05_atr_wilder": ind.atr,
    "f06_atr_sma": ind.atr_sma,
    "f08_rsi": ind.rsi,
    "f09_rsi_default": ind.rsi_default,
    "f10_rsi_wilder": ind.rsi_wilder,
    "f12_adx": ind.adx,
    "f13_adx_sma": ind.adx_sma,
    "f15_ema_cross": ind.ema_cross,
    "f16_supertrend": ind.supertrend,
    "f17_ichimoku": ind.ichimoku,
    "f18_parabolic_sar": ind.parabolic_sar,
    "f19_aroon": ind.aroon,
    "f20_vwap_dev": ind.vwap_dev,
    "f22_macd": ind.macd,
    "f23_stochastic": ind.stochastic,
    "f24_cci": ind.cci,
    "f25_williams": ind.williams,
    "f26_roc": ind.roc,
    "f27_mfi": ind.mfi,
    "f28_bollinger": ind.bollinger,
    "f29_atr_ratio": ind.atr_ratio,
    "f30_keltner": ind.keltner,
    "f31_donchian": ind.donchian,
    "f32_hist_vol": ind.hist_vol,
    "f33_obv": ind.obv,
    "f33_obv_slope": ind.obv_slope,
    "f34_vol_trend": ind.vol_trend,
    "f35_vwap_ratio": ind.vwap_ratio,
    "f36_acc_dist": ind.acc_dist,
    "f37_cmf": ind.cmf,
    "f38_gap_state": ind.gap_state,
    "f39_break_of_structure": ind.break_of_structure,
    "f40_session_range": ind.session_range,
    "f41_displacement": ind.displacement,
    "f42_sweep_state": ind.sweep_state,
    "f43_order_block_state": ind.order_block_state,
    "f48_volume_z": ind.volume_z,
    "f49_entropy": ind.entropy,
    "f50_flow_autocorr": ind.flow_autocorr,
    "f51_hurst_rescaled": ind.hurst_rescaled,
    "f52_hurst_ratio": ind.hurst_ratio,
    "f56_momentum_12_1": ind.momentum_12_1,
    "f59_rolling_z": ind.rolling_z,
    "f60_pct_rank": ind.pct_rank,
    "f61_range_index": ind.range_index,
    "f62_swing_points": ind.swing_points,
    "f64_range_position": ind.range_position,
    "f66_sweep_events": ind.sweep_events,
    "f67_gap_events": ind.gap_events,
    "f68_order_blocks": ind.order_blocks,
    "f74_trapped": ind.trapped,
    "f76_rolling_sharpe": ind.rolling_sharpe,
    "f78_drawdown": ind.drawdown,
    "f81_vol_percentile": ind.vol_percentile,
    "f82_vol_slope": ind.vol_slope,
    "f90_donchian_entry": ind.donchian_entry,
    "b03_returns": ind.returns,
    "b04_legacy_return": ind.legacy_return,
    "j16_forward_label": ind.forward_return_label,
}

QUERIES = {name: _over_bars(f) for name, f in FUNCTIONS.items()}

TRX = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
TPX = "(high + low + close) / 3"
CLVX = "((close - low) - (high - close)) / nullif(high - low, 0)"


def one(raw: str, state: str = "0", pre: str = "*") -> str:
    """Two steps: columns, then the value."""
    return steps(("a", f"SELECT {pre} FROM bars"), ("b", f"SELECT *, {raw} AS raw FROM a"), state=state)


def rec(chain: str, body: str, state: str = "0") -> str:
    """Over recursive steps; body gives symbol, bar_no, raw and others."""
    return f"WITH RECURSIVE {BARS}, {chain}, fin AS ({body}) SELECT symbol, bar_no, round(raw, 6) AS raw, CAST(coalesce({state}, 0) AS INTEGER) AS state FROM fin"


GAIN = f"*, greatest(close - {lag('close')}, 0) AS gain0, greatest({lag('close')} - close, 0) AS loss0"
RSI_STEPS = (("a", f"SELECT *, CASE WHEN bar_no = 1 THEN 0 ELSE greatest(close - {lag('close')}, 0) END AS gain, CASE WHEN bar_no = 1 THEN 0 ELSE greatest({lag('close')} - close, 0) END AS loss FROM bars"),)
VW = f"*, sum({TPX} * nullif(volume, 0)) {w(20)} / sum(nullif(volume, 0)) {w(20)} AS vwap0, count(nullif(volume, 0)) {w(20)} AS nv"
TRS = f"trs AS (SELECT *, {TRX} AS tr FROM bars)"
ATR14 = TRS + ", " + wilder_cte("atr", "trs", "tr", 14)
OBVX = f"CASE WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume ELSE 0 END"
ALL = "OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

SQL = {
    "f01_true_range": one(TRX),
    "f02_sma": one(full("avg", "close", 20), band("close - raw", 0, 0)),
    "f03_ema": rec(ewm_cte("e1", "bars", "close", "(2.0 / 21)"), "SELECT e.symbol, e.bar_no, e.e AS raw, close FROM e1 e JOIN bars b USING (symbol, bar_no)", band("close - raw", 0, 0)),
    "f04_ema_adjusted": rec(
        "r AS (SELECT symbol, bar_no, close AS num, CAST(1 AS DOUBLE) AS den FROM bars WHERE bar_no = 1 UNION ALL SELECT b.symbol, b.bar_no, b.close + (1 - 2.0 / 21) * r.num, 1 + (1 - 2.0 / 21) * r.den FROM r JOIN bars b ON b.symbol = r.symbol AND b.bar_no = r.bar_no + 1)",
        "SELECT symbol, bar_no, num / den AS raw FROM r",
    ),
    "f16_supertrend": rec(
        TRS
        + ", "
        + wilder_cte("atr", "trs", "tr", 10)
        + f""", d AS (SELECT symbol, bar_no, close, {lag('close')} AS c1, (high + low) / 2 + 3 * e AS hi0, (high + low) / 2 - 3 * e AS lo0 FROM trs LEFT JOIN atr USING (symbol, bar_no)),
        r AS (SELECT symbol, bar_no, CAST(NULL AS DOUBLE) AS line, 0 AS side FROM d WHERE bar_no = 1
          UNION ALL SELECT symbol, bar_no, CASE WHEN lo0 IS NULL THEN NULL WHEN close > hi THEN lo WHEN close < lo THEN hi ELSE held END, CASE WHEN close > hi THEN 1 WHEN close < lo THEN -1 ELSE side END
          FROM (SELECT *, CASE WHEN lo0 > held OR c1 < held THEN lo0 ELSE greatest(held, lo0) END AS lo, CASE WHEN hi0 < held OR c1 > held THEN hi0 ELSE least(held, hi0) END AS hi
            FROM (SELECT d.*, r.side, coalesce(r.line, d.lo0) AS held FROM r JOIN d ON d.symbol = r.symbol AND d.bar_no = r.bar_no + 1)))""",
        "SELECT symbol, bar_no, line AS raw, side FROM r",
        "side",
    ),
    "f18_parabolic_sar": rec(
        f"""d AS (SELECT symbol, bar_no, high AS h, low AS l, {lag('high')} AS h1, {lag('low')} AS l1, coalesce({lag('high', 2)}, {lag('high')}) AS h2, coalesce({lag('low', 2)}, {lag('low')}) AS l2 FROM bars),
        r AS (SELECT symbol, bar_no, l AS stop, h AS ext, CAST(0.02 AS DOUBLE) AS speed, true AS up FROM d WHERE bar_no = 1
          UNION ALL SELECT symbol, bar_no, CASE WHEN flip THEN ext ELSE a END, CASE WHEN flip THEN CASE WHEN up THEN l ELSE h END WHEN up THEN greatest(h, ext) ELSE least(l, ext) END,
          CASE WHEN flip THEN 0.02 WHEN CASE WHEN up THEN h > ext ELSE l < ext END THEN least(speed + 0.02, 0.2) ELSE speed END, up <> flip
          FROM (SELECT *, CASE WHEN up THEN l < a ELSE h > a END AS flip
            FROM (SELECT *, CASE WHEN up THEN least(a0, l1, l2) ELSE greatest(a0, h1, h2) END AS a
              FROM (SELECT d.*, r.ext, r.speed, r.up, r.stop + r.speed * (r.ext - r.stop) AS a0 FROM r JOIN d ON d.symbol = r.symbol AND d.bar_no = r.bar_no + 1))))""",
        "SELECT symbol, bar_no, stop AS raw, up FROM r",
        "CASE WHEN up THEN 1 ELSE -1 END",
    ),
    "f05_atr_wilder": rec(ATR14, "SELECT symbol, bar_no, e AS raw FROM atr"),
    "f06_atr_sma": one(f"coalesce({full('avg', 'tr', 14)}, greatest(close * 1e-4, 1e-9))", pre=f"*, {TRX} AS tr"),
    "f08_rsi": steps(*RSI_STEPS, ("b", f"SELECT *, 100 - 100 / (1 + {full('avg', 'gain', 14)} / nullif({full('avg', 'loss', 14)}, 0)) AS raw FROM a"), state=band("raw", 40, 60)),
    "f09_rsi_default": steps(*RSI_STEPS, ("b", f"SELECT *, CASE WHEN bar_no <= 14 THEN 50 WHEN avg(loss) {w(14)} = 0 THEN 100 ELSE 100 - 100 / (1 + avg(gain) {w(14)} / nullif(avg(loss) {w(14)}, 0)) END AS raw FROM a"), state=band("raw", 40, 60)),
    "f10_rsi_wilder": rec(
        "d AS (SELECT symbol, bar_no - 1 AS bar_no, greatest(c, 0) AS g, greatest(-c, 0) AS l FROM (SELECT *, close - " + lag("close") + " AS c FROM bars) WHERE bar_no > 1), " + ewm_cte("eg", "d", "g", "(1.0 / 14)") + ", " + ewm_cte("el", "d", "l", "(1.0 / 14)"),
        "SELECT b.symbol, b.bar_no, 100 - 100 / (1 + eg.e / nullif(el.e, 0)) AS raw FROM bars b LEFT JOIN eg ON eg.symbol = b.symbol AND eg.bar_no = b.bar_no - 1 LEFT JOIN el ON el.symbol = b.symbol AND el.bar_no = b.bar_no - 1",
        band("raw", 40, 60),
    ),
    "f12_adx": rec(
        ATR14
        + f", dm AS (SELECT symbol, bar_no, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM bars), dm2 AS (SELECT symbol, bar_no, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m FROM dm), "
        + wilder_cte("ep", "dm2", "p", 14)
        + ", "
        + wilder_cte("em", "dm2", "m", 14)
        + ", di AS (SELECT symbol, bar_no, 100 * ep.e / atr.e AS pdi, 100 * em.e / atr.e AS mdi FROM ep JOIN em USING (symbol, bar_no) JOIN atr USING (symbol, bar_no)), dxs AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di), "
        + wilder_cte("ax", "dxs", "dx", 14),
        "SELECT d.symbol, d.bar_no, ax.e AS raw, pdi, mdi FROM dxs d LEFT JOIN ax USING (symbol, bar_no)",
        "CASE WHEN raw >= 20 THEN CASE WHEN pdi > mdi THEN 1 ELSE -1 END ELSE 0 END",
    ),
    "f13_adx_sma": steps(
        ("a", f"SELECT *, greatest(coalesce(high - {lag('high')}, 0), 0) AS p0, greatest(coalesce({lag('low')} - low, 0), 0) AS m0, {TRX} AS tr FROM bars"),
        ("b", "SELECT *, CASE WHEN p0 < m0 THEN 0 ELSE p0 END AS p FROM a"),
        ("c", "SELECT *, CASE WHEN m0 < p THEN 0 ELSE m0 END AS m FROM b"),
        ("d", f"SELECT *, 100 * {full('avg', 'p', 14)} / nullif({full('avg', 'tr', 14)}, 0) AS pi, 100 * {full('avg', 'm', 14)} / nullif({full('avg', 'tr', 14)}, 0) AS mi FROM c"),
        ("e", "SELECT *, 100 * abs(pi - mi) / nullif(pi + mi, 0) AS dx FROM d"),
        ("f", f"SELECT *, {full('avg', 'dx', 14)} AS raw FROM e"),
        state="CASE WHEN pi > mi THEN 1 WHEN pi < mi THEN -1 ELSE 0 END",
    ),
    "f15_ema_cross": rec(ewm_cte("e1", "bars", "close", "(2.0 / 21)") + ", " + ewm_cte("e2", "bars", "close", "(2.0 / 51)"), "SELECT symbol, bar_no, (e1.e - e2.e) / e2.e * 100 AS raw FROM e1 JOIN e2 USING (symbol, bar_no)", f"CASE WHEN abs(raw) < 0.05 THEN 0 ELSE {band('raw', 0, 0)} END"),
    "f17_ichimoku": steps(
        ("a", f"SELECT *, ({full('max', 'high', 9)} + {full('min', 'low', 9)}) / 2 AS t, ({full('max', 'high', 26)} + {full('min', 'low', 26)}) / 2 AS k, ({full('max', 'high', 52)} + {full('min', 'low', 52)}) / 2 AS s FROM bars"),
        ("b", f"SELECT *, coalesce({lag('(t + k) / 2', 26)}, close) AS sa, coalesce({lag('s', 26)}, close) AS sb FROM a"),
        ("c", "SELECT *, CASE WHEN bar_no >= 52 THEN greatest(sa, sb) END AS raw FROM b"),
        state="CASE WHEN bar_no < 52 THEN 0 WHEN close > greatest(sa, sb) THEN 1 WHEN close < least(sa, sb) THEN -1 ELSE 0 END",
    ),
    "f19_aroon": steps(
        ("a", f"SELECT *, list(high) {w(26)} AS hs, list(low) {w(26)} AS ls FROM bars"),
        ("b", "SELECT *, CASE WHEN bar_no > 25 THEN (25 - (list_position(hs, list_max(hs)) - 1)) / 25.0 * 100 - (25 - (list_position(ls, list_min(ls)) - 1)) / 25.0 * 100 END AS raw FROM a"),
        state=band("raw", -50, 50),
    ),
    "f20_vwap_dev": steps(("a", f"SELECT {VW} FROM bars"), ("b", "SELECT *, CASE WHEN nv = 20 THEN vwap0 END AS vwap FROM a"), ("c", f"SELECT *, (close - vwap) / nullif({full('stddev_samp', 'vwap', 20)}, 0) AS raw FROM b"), state=band("raw", -1, 1)),
    "f22_macd": rec(
        ewm_cte("e1", "bars", "close", "(2.0 / 13)") + ", " + ewm_cte("e2", "bars", "close", "(2.0 / 27)") + ", li AS (SELECT symbol, bar_no, e1.e - e2.e AS x FROM e1 JOIN e2 USING (symbol, bar_no)), " + ewm_cte("e3", "li", "x", "(2.0 / 10)") + ", hi AS (SELECT symbol, bar_no, x - e AS h FROM li JOIN e3 USING (symbol, bar_no))",
        f"SELECT symbol, bar_no, h AS raw, h > coalesce({lag('h')}, h) AS rising FROM hi",
        "CASE WHEN raw > 0 AND rising THEN 1 WHEN raw < 0 AND NOT rising THEN -1 ELSE 0 END",
    ),
    "f23_stochastic": steps(
        ("a", f"SELECT *, 100 * (close - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) AS raw FROM bars"),
        ("b", f"SELECT *, {full('avg', 'raw', 3)} AS d FROM a"),
        state="CASE WHEN raw > 50 AND d > 50 AND raw > d THEN 1 WHEN raw < 50 AND d < 50 AND raw < d THEN -1 ELSE 0 END",
    ),
    "f24_cci": steps(
        ("a", f"SELECT *, {TPX} AS tp FROM bars"),
        ("b", f"SELECT *, list(tp) {w(20)} AS xs, {full('avg', 'tp', 20)} AS m FROM a"),
        ("c", "SELECT *, (tp - m) / nullif(0.015 * list_avg(list_transform(xs, lambda x: abs(x - m))), 0) AS raw FROM b"),
        state=band("raw", -100, 100),
    ),
    "f25_williams": one(f"-100 * ({full('max', 'high', 14)} - close) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0)", band("raw", -80, -20)),
    "f26_roc": one(f"(close / {lag('close', 10)} - 1) * 100", band("raw", -0.5, 0.5)),
    "f27_mfi": steps(
        ("a", f"SELECT *, {TPX} AS tp FROM bars"),
        ("b", f"SELECT *, CASE WHEN tp > {lag('tp')} THEN tp * volume ELSE 0 END AS pos, CASE WHEN tp < {lag('tp')} THEN tp * volume ELSE 0 END AS neg FROM a"),
        ("c", f"SELECT *, 100 - 100 / (1 + {full('sum', 'pos', 14)} / nullif({full('sum', 'neg', 14)}, 0)) AS raw FROM b"),
        state=band("raw", 40, 60),
    ),
    "f28_bollinger": one(f"(close - ({full('avg', 'close', 20)} - 2 * {full('stddev_samp', 'close', 20)})) / nullif(4 * {full('stddev_samp', 'close', 20)}, 0)", band("raw", 0.2, 0.8)),
    "f29_atr_ratio": rec(ATR14 + ", p AS (SELECT symbol, bar_no, e / close AS p FROM atr JOIN bars USING (symbol, bar_no))", f"SELECT symbol, bar_no, (p - {full('avg', 'p', 90)}) / nullif({full('stddev_samp', 'p', 90)}, 0) AS raw FROM p"),
    "f30_keltner": rec(ATR14 + ", " + ewm_cte("e1", "bars", "close", "(2.0 / 21)"), "SELECT symbol, bar_no, (close - e1.e) / nullif(2 * atr.e, 0) AS raw FROM e1 JOIN atr USING (symbol, bar_no) JOIN bars USING (symbol, bar_no)", band("raw", -1, 1)),
    "f31_donchian": one(f"({full('max', 'high', 20)} + {full('min', 'low', 20)}) / 2", band("(close - raw) / raw", -0.001, 0.001)),
    "f32_hist_vol": steps(("a", f"SELECT *, ln(close / {lag('close')}) AS lr, close / {lag('close', 19)} - 1 AS mv FROM bars"), ("b", f"SELECT *, {full('stddev_samp', 'lr', 20)} * sqrt(252) AS raw FROM a"), state=f"CASE WHEN raw <= 0.12 THEN {band('mv', -0.005, 0.005)} ELSE 0 END"),
    "f33_obv": steps(("a", f"SELECT *, {OBVX} AS x FROM bars"), ("b", f"SELECT *, sum(x) {ALL} AS raw FROM a")),
    "f33_obv_slope": rec(f"o1 AS (SELECT *, {OBVX} AS x FROM bars), o2 AS (SELECT symbol, bar_no, sum(x) {ALL} AS x FROM o1), " + ewm_cte("e1", "o2", "x", "(2.0 / 21)"), f"SELECT symbol, bar_no, e - {lag('e', 19)} AS raw FROM e1", band("raw", 0, 0)),
    "f34_vol_trend": one(f"(volume - {full('avg', 'volume', 20)}) / nullif({full('stddev_samp', 'volume', 20)}, 0)", "CASE WHEN raw > 1.5 AND up THEN 1 WHEN raw > 1.5 AND NOT up THEN -1 ELSE 0 END", pre=f"*, close > {lag('close')} AS up"),
    "f35_vwap_ratio": steps(("a", f"SELECT {VW} FROM bars"), ("b", "SELECT *, CASE WHEN nv = 20 THEN close / vwap0 END AS raw FROM a"), state=band("raw", 0.999, 1.001)),
    "f36_acc_dist": steps(("a", f"SELECT *, {CLVX} * volume AS x FROM bars"), ("b", f"SELECT *, sum(x) {ALL} AS raw FROM a")),
    "f37_cmf": one(f"{full('sum', 'x', 20)} / nullif({full('sum', 'volume', 20)}, 0)", band("raw", -0.05, 0.05), pre=f"*, {CLVX} * volume AS x"),
    "f38_gap_state": steps(("a", f"SELECT *, CASE WHEN low > {lag('high', 2)} THEN 1 WHEN high < {lag('low', 2)} THEN -1 END AS g FROM bars"), ("b", f"SELECT *, CAST(last_value(g IGNORE NULLS) {w(10)} AS DOUBLE) AS raw FROM a"), state="raw"),
    "f39_break_of_structure": one(f"CASE WHEN bar_no >= 20 THEN max(high) {w(10, 5)} END", "CASE WHEN close > raw THEN 1 WHEN close < lo THEN -1 ELSE 0 END", pre=f"*, CASE WHEN bar_no >= 20 THEN min(low) {w(10, 5)} END AS lo"),
    "f40_session_range": one(f"CASE WHEN bar_no >= 10 THEN max(high) {w(5, 5)} END", "CASE WHEN close > raw THEN 1 WHEN close < lo THEN -1 ELSE 0 END", pre=f"*, CASE WHEN bar_no >= 10 THEN min(low) {w(5, 5)} END AS lo"),
    "f41_displacement": rec(ATR14, "SELECT b.*, abs(close - open) / nullif(e, 0) AS raw FROM bars b LEFT JOIN atr USING (symbol, bar_no)", "CASE WHEN bar_no >= 20 AND raw >= 2 THEN CASE WHEN close > open THEN 1 ELSE -1 END ELSE 0 END"),
    "f42_sweep_state": steps(
        ("a", f"SELECT *, CASE WHEN bar_no >= 15 THEN max(high) {w(10, 5)} END AS raw, min(low) {w(10, 5)} AS lo, max(high) {w(5)} AS rh, min(low) {w(5)} AS rl FROM bars"),
        state="CASE WHEN bar_no < 15 THEN 0 WHEN rh > raw AND close < raw THEN -1 WHEN rl < lo AND close > lo THEN 1 ELSE 0 END",
    ),
    "f43_order_block_state": steps(
        ("a", "SELECT *, CASE WHEN close < open THEN {'h': high, 'l': low} END AS dc, CASE WHEN close > open THEN {'h': high, 'l': low} END AS uc FROM bars"),
        ("b", f"SELECT *, CASE WHEN bar_no >= 25 THEN max(high) {w(15, 5)} END AS raw, min(low) {w(15, 5)} AS lo, last_value(dc IGNORE NULLS) {w(15, 4)} AS d, last_value(uc IGNORE NULLS) {w(15, 4)} AS u FROM a"),
        state="CASE WHEN bar_no < 25 THEN 0 WHEN close > raw AND d.l < close AND d.h * 1.002 > close THEN 1 WHEN close < lo AND u.l * 0.998 < close AND u.h > close THEN -1 ELSE 0 END",
    ),
    "f48_volume_z": one(f"coalesce((volume - {full('avg', 'volume', 20)}) / nullif({full('stddev_samp', 'volume', 20)}, 0), 0)"),
    "f49_entropy": steps(
        ("a", f"SELECT *, list(close) {w(20)} AS xs, {full('min', 'close', 20)} AS lo, {full('max', 'close', 20)} AS hi FROM bars"),
        ("b", "SELECT *, list_transform(xs, lambda x: least(floor((x - lo) / nullif(hi - lo, 0) * 10), 9)) AS bs FROM a"),
        ("c", "SELECT *, CASE WHEN hi > lo THEN list_sum(list_transform(list_distinct(bs), lambda b: -(len(list_filter(bs, lambda y: y = b)) / 20.0) * log2(len(list_filter(bs, lambda y: y = b)) / 20.0))) WHEN hi = lo THEN 0 END AS raw FROM b"),
    ),
    "f50_flow_autocorr": steps(("a", "SELECT *, sign(close - open) * volume AS f FROM bars"), ("b", f"SELECT *, {lag('f')} AS g FROM a"), ("c", f"SELECT *, CASE WHEN bar_no >= 20 THEN corr(f, g) {w(19)} END AS raw FROM b")),
    "f51_hurst_rescaled": steps(
        ("a", f"SELECT *, ln(close / {lag('close')}) AS lr FROM bars"),
        ("b", f"SELECT *, CASE WHEN count(lr) {w(32)} = 32 THEN list(lr) {w(32)} END AS xs, stddev_pop(lr) {w(32)} AS s FROM a"),
        ("c", "SELECT *, list_transform(range(1, 33), lambda k: list_sum(xs[1:k]) - k * list_avg(xs)) AS cs FROM b"),
        ("d", "SELECT *, CASE WHEN xs IS NULL THEN NULL WHEN s > 0 AND list_max(cs) > list_min(cs) THEN ln((list_max(cs) - list_min(cs)) / s) / ln(32) ELSE 0.5 END AS raw FROM c"),
    ),
    "f52_hurst_ratio": steps(("a", f"SELECT *, ln(close / {lag('close')}) AS r1, ln(close / {lag('close', 2)}) AS r2 FROM bars"), ("b", f"SELECT *, least(greatest(0.5 + 0.5 * log2({full('var_pop', 'r2', 40)} / nullif(2 * {full('var_pop', 'r1', 40)}, 0)), CASE WHEN count(r2) {w(40)} = 40 THEN 0.1 END), CASE WHEN count(r2) {w(40)} = 40 THEN 0.9 END) AS raw0, count(r2) {w(40)} AS n FROM a"), ("c", "SELECT *, CASE WHEN n = 40 THEN raw0 ELSE 0.1 END AS raw FROM b"), state="CASE WHEN raw > 0.52 THEN 1 WHEN raw < 0.45 THEN -1 ELSE 0 END"),
    "f56_momentum_12_1": one(f"{lag('close', 21)} / {lag('close', 252)} - 1"),
    "f59_rolling_z": one(f"CASE WHEN count(close) {w(60)} >= 30 THEN (close - avg(close) {w(60)}) / nullif(stddev_samp(close) {w(60)}, 0) END", band("raw", -2, 2)),
    "f60_pct_rank": one("CASE WHEN bar_no >= 60 THEN len(list_filter(xs, lambda x: x <= close)) / 60.0 END", pre=f"*, list(close) {w(60)} AS xs"),
    "f61_range_index": one(f"100 * (close - {full('min', 'close', 60)}) / nullif({full('max', 'close', 60)} - {full('min', 'close', 60)}, 0)", band("raw", 20, 80)),
    "f62_swing_points": steps(("a", "SELECT *, count(*) OVER a AS n, max(high) OVER a AS hi, min(low) OVER a AS lo FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"), ("b", "SELECT *, CASE WHEN n = 7 THEN hi END AS raw FROM a"), state="CASE WHEN n < 7 THEN 0 WHEN high = hi THEN 1 WHEN low = lo THEN -1 ELSE 0 END"),
    "f64_range_position": one(f"(close - {full('min', 'low', 20)}) / nullif({full('max', 'high', 20)} - {full('min', 'low', 20)}, 0)", "CASE WHEN raw < 0.5 THEN 1 WHEN raw > 0.5 THEN -1 ELSE 0 END"),
    "f66_sweep_events": steps(
        ("a", f"SELECT *, {TRX} AS tr FROM bars"),
        ("b", f"SELECT *, {full('avg', 'tr', 14)} AS t, {full('min', 'low', 20, 1)} AS lo, {full('max', 'high', 20, 1)} AS hi, lead(close, 3) {BY} AS later FROM a"),
        ("c", "SELECT b.*, m.t AS atr FROM b JOIN (SELECT symbol, arg_max(t, bar_no) FILTER (t IS NOT NULL) AS t FROM b GROUP BY 1) m USING (symbol)"),
        ("d", "SELECT *, CASE WHEN low < lo AND close > lo AND lo - low >= 0.3 * atr THEN 1 WHEN high > hi AND close < hi AND high - hi >= 0.3 * atr THEN -1 ELSE 0 END AS side FROM c"),
        ("e", "SELECT *, CASE WHEN side = 1 THEN CAST(later > close AS DOUBLE) WHEN side = -1 THEN CAST(later < close AS DOUBLE) END AS raw FROM d"),
        state="side",
    ),
    "f67_gap_events": steps(
        ("a", f"SELECT *, {TRX} AS tr, low - {lag('high', 2)} AS up, {lag('low', 2)} - high AS dn FROM bars"),
        ("b", f"SELECT *, {full('avg', 'tr', 14)} AS atr, CASE WHEN up > 0 THEN up WHEN dn > 0 THEN dn END AS sz FROM a"),
        ("c", "SELECT *, CASE WHEN sz >= 0.3 * atr THEN sz END AS raw FROM b"),
        state="CASE WHEN raw IS NOT NULL THEN CASE WHEN up > 0 THEN 1 ELSE -1 END END",
    ),
    "f68_order_blocks": steps(
        ("a", f"SELECT *, {TRX} AS tr, lead(close) {BY} - lead(open) {BY} AS mv FROM bars"),
        ("b", f"SELECT *, {full('avg', 'tr', 14)} AS atr FROM a"),
        ("c", "SELECT *, CASE WHEN close < open AND mv >= 1.5 * atr THEN 1 WHEN close > open AND -mv >= 1.5 * atr THEN -1 END AS s FROM b"),
        ("d", "SELECT *, CASE WHEN s IS NOT NULL THEN abs(mv) END AS raw FROM c"),
        state="s",
    ),
    "f74_trapped": steps(("a", f"SELECT *, (close - {full('avg', 'close', 10)}) / {full('avg', 'close', 10)} AS d FROM bars"), ("b", "SELECT *, CASE WHEN d IS NULL THEN 0.8 ELSE least(5 * abs(d), 0.8) END AS raw FROM a"), state="CASE WHEN d < -0.02 THEN 1 WHEN d > 0.02 THEN -1 ELSE 0 END"),
    "f76_rolling_sharpe": steps(("a", f"SELECT *, close / {lag('close')} - 1 AS r FROM bars"), ("b", f"SELECT *, {full('avg', 'r', 30)} / nullif({full('stddev_pop', 'r', 30)}, 0) * sqrt(252) AS raw FROM a")),
    "f78_drawdown": steps(("a", f"SELECT *, max(close) {ALL} AS peak, arg_max(bar_no, close) {ALL} AS top_no FROM bars"), ("b", "SELECT *, (close - peak) / peak * 100 AS raw FROM a"), state="bar_no - top_no"),
    "f81_vol_percentile": steps(("a", "SELECT *, (high - low) / close AS g FROM bars"), ("b", f"SELECT *, list(g) {w(100, 1)} AS xs FROM a"), ("c", "SELECT *, CASE WHEN len(xs) = 100 THEN len(list_filter(xs, lambda x: x < g)) / 100.0 END AS raw FROM b")),
    "f82_vol_slope": steps(("a", "SELECT *, high - low AS g FROM bars"), ("b", f"SELECT *, CASE WHEN bar_no >= 6 THEN regr_slope(g, bar_no) {w(6)} / nullif(avg(g) {w(6)}, 0) END AS raw FROM a"), state=band("raw", -0.02, 0.02)),
    "f90_donchian_entry": one(full("max", "close", 30, 1), "CASE WHEN close > f AND close > raw THEN 1 WHEN close < g AND close < s THEN -1 ELSE 0 END", pre=f"*, {full('max', 'close', 10, 1)} AS f, {full('min', 'close', 10, 1)} AS g, {full('min', 'close', 30, 1)} AS s"),
    "b03_returns": one(f"coalesce(close / {lag('close', 5)} - 1, 0)"),
    "b04_legacy_return": one(f"(close - {lag('close', 4)}) / close"),
    "j16_forward_label": one(f"lead(close, 4) {BY} / close - 1", "CAST(raw > 0.001 AS INTEGER)"),
}

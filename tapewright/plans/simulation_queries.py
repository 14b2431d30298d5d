"""Signals, simulated trades, account rules and resampling tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions.frames import highest, lowest, mean, prev, true_range
from tapewright.operators import account, asof, drawing, simulate
from tapewright.operators import metrics as m
from tapewright.plans.registry import Registry
from tapewright.plans.sql import BARS, TRADES, full, lag
from tapewright.sources.market import IN_ORDER, bars, table, trades
from tapewright.sources.staging import staged

query = Registry()
QUERIES, SQL = query.queries, query.sql
ORDER_SQL = ", ".join(IN_ORDER)

SIGNALS = f"""{BARS}, s0 AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, {full('avg', 'close', 5)} AS fast, {full('avg', 'close', 15)} AS slow FROM bars),
s1 AS (SELECT *, {full('avg', 'tr', 14)} AS atr, {lag('fast')} AS fast1, {lag('slow')} AS slow1 FROM s0),
sig AS (SELECT symbol, bar_no, open, high, low, close, coalesce(atr, 0) AS atr, CASE WHEN fast > slow AND fast1 <= slow1 THEN 1 WHEN fast < slow AND fast1 >= slow1 THEN -1 ELSE 0 END AS signal FROM s1)"""


def signals(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Bars with their mean range and a signal where two means cross, and ``more`` of their columns."""
    b = bars(spark, sf_dir).withColumn("tr", true_range()).withColumn("fast", F.round(mean("close", 5), 9)).withColumn("slow", F.round(mean("close", 15), 9))
    b = b.withColumn("f1", prev("fast")).withColumn("s1", prev("slow")).withColumn("atr", F.coalesce(mean("tr", 14), F.lit(0.0)))
    up, down = (F.col("fast") > F.col("slow")) & (F.col("f1") <= F.col("s1")), (F.col("fast") < F.col("slow")) & (F.col("f1") >= F.col("s1"))
    return b.select("symbol", "bar_no", *more, "open", "high", "low", "close", "atr", F.when(up, 1).when(down, -1).otherwise(0).alias("signal"))


SIGNALS = SIGNALS.replace(f"{full('avg', 'close', 5)} AS fast", f"round({full('avg', 'close', 5)}, 9) AS fast").replace(f"{full('avg', 'close', 15)} AS slow", f"round({full('avg', 'close', 15)}, 9) AS slow")


@query("j01_crossover", f"WITH {SIGNALS} SELECT symbol, bar_no, signal, round(CASE WHEN signal <> 0 THEN least(greatest(abs(close - open) / nullif(atr, 0), 0.1), 0.95) ELSE 0 END, 6) AS confidence FROM sig")
def crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.least(F.greatest(F.abs(F.col("close") - F.col("open")) / F.nullif(F.col("atr"), F.lit(0.0)), F.lit(0.1)), F.lit(0.95))
    return signals(spark, sf_dir).select("symbol", "bar_no", "signal", F.round(F.when(F.col("signal") != 0, x).otherwise(0.0), 6).alias("confidence"))


@query("j01_breakout", f"WITH {BARS}, d AS (SELECT symbol, bar_no, close, {full('max', 'high', 20, 1)} AS hi, {full('min', 'low', 20, 1)} AS lo FROM bars) SELECT symbol, bar_no, CASE WHEN close > hi THEN 1 WHEN close < lo THEN -1 ELSE 0 END AS signal FROM d")
def breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("close")
    return bars(spark, sf_dir).select("symbol", "bar_no", F.when(c > highest("high", 20, 1), 1).when(c < lowest("low", 20, 1), -1).otherwise(0).alias("signal"))


def bracket_sql(gap_long: str = "b.open", gap_short: str = "b.open", stop: float = 1.5, reward: float = 2.0, windows: int = 0) -> str:
    """Trades by recursion over bars; with ``windows`` each so many bars are a series of their own, and reasons are given."""
    x = f"""CASE WHEN p.pos = 1 THEN CASE WHEN b.open <= p.stop THEN {gap_long} WHEN b.low <= p.stop THEN p.stop WHEN b.high >= p.target THEN p.target END
      WHEN p.pos = -1 THEN CASE WHEN b.open >= p.stop THEN {gap_short} WHEN b.high >= p.stop THEN p.stop WHEN b.low <= p.target THEN p.target END END"""
    new = "p.pos = 0 AND b.signal <> 0 AND b.atr > 0"
    entry = "b.close * (1 + b.signal * 0.0005)"
    if windows:
        why = "CASE WHEN p.pos = 1 AND (b.open <= p.stop OR b.low <= p.stop) OR p.pos = -1 AND (b.open >= p.stop OR b.high >= p.stop) THEN 'stop' ELSE 'target' END"
        return f"""WITH RECURSIVE {SIGNALS}, sw AS (SELECT *, (bar_no - 1) // {windows} AS window_no FROM sig), sim AS (SELECT DISTINCT symbol, window_no, CAST(window_no * {windows} AS BIGINT) AS bar_no, 0 AS pos, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS stop, CAST(0 AS DOUBLE) AS target, CAST(0 AS BIGINT) AS entry_bar, CAST(NULL AS DOUBLE) AS x, 0 AS was, '' AS reason FROM sw
          UNION ALL SELECT b.symbol, b.window_no, b.bar_no, CASE WHEN p.pos <> 0 THEN CASE WHEN ({x}) IS NULL THEN p.pos ELSE 0 END WHEN {new} THEN b.signal ELSE 0 END,
          CASE WHEN {new} THEN {entry} ELSE p.entry END, CASE WHEN {new} THEN {entry} - b.signal * {stop} * b.atr ELSE p.stop END, CASE WHEN {new} THEN {entry} + b.signal * {reward} * {stop} * b.atr ELSE p.target END,
          CASE WHEN {new} THEN b.bar_no ELSE p.entry_bar END, {x}, p.pos, {why} FROM sim p JOIN sw b ON b.symbol = p.symbol AND b.window_no = p.window_no AND b.bar_no = p.bar_no + 1)
          SELECT symbol, window_no, entry_bar, bar_no AS exit_bar, was AS direction, round(entry, 6) AS entry, round(x, 6) AS exit, reason FROM sim WHERE x IS NOT NULL"""
    return f"""WITH RECURSIVE {SIGNALS}, sim AS (SELECT symbol, bar_no, 0 AS pos, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS stop, CAST(0 AS DOUBLE) AS target, CAST(0 AS BIGINT) AS entry_bar, CAST(NULL AS DOUBLE) AS x, 0 AS was FROM sig WHERE bar_no = 1
      UNION ALL SELECT b.symbol, b.bar_no, CASE WHEN p.pos <> 0 THEN CASE WHEN ({x}) IS NULL THEN p.pos ELSE 0 END WHEN {new} THEN b.signal ELSE 0 END,
      CASE WHEN {new} THEN {entry} ELSE p.entry END, CASE WHEN {new} THEN {entry} - b.signal * {stop} * b.atr ELSE p.stop END, CASE WHEN {new} THEN {entry} + b.signal * {reward} * {stop} * b.atr ELSE p.target END,
      CASE WHEN {new} THEN b.bar_no ELSE p.entry_bar END, {x}, p.pos FROM sim p JOIN sig b ON b.symbol = p.symbol AND b.bar_no = p.bar_no + 1)
      SELECT symbol, entry_bar, bar_no AS exit_bar, was AS direction, round(entry, 6) AS entry, round(x, 6) AS exit FROM sim WHERE x IS NOT NULL"""


def rounded(t: DataFrame) -> DataFrame:
    return t.withColumn("entry", F.round("entry", 6)).withColumn("exit", F.round("exit", 6))


OHLC = ["open", "high", "low", "close", "signal", "atr"]


@query("j02_bracket_trades", bracket_sql())
def bracket_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.trades_of(signals(spark, sf_dir), ["symbol"], OHLC, simulate.bracket())).drop("reason")


@query("j05_gap_at_best", bracket_sql("greatest(b.open, p.stop)", "least(b.open, p.stop)"))
def gap_at_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.trades_of(signals(spark, sf_dir), ["symbol"], OHLC, simulate.bracket(gap="best"))).drop("reason")


SURE = bracket_sql().replace("coalesce(atr, 0) AS atr, CASE WHEN fast > slow AND fast1 <= slow1 THEN 1 WHEN fast < slow AND fast1 >= slow1 THEN -1 ELSE 0 END AS signal FROM s1)", "coalesce(atr, 0) AS atr, CASE WHEN least(greatest(abs(close - open) / nullif(coalesce(atr, 0), 0), 0.1), 0.95) < 0.3 THEN 0 WHEN fast > slow AND fast1 <= slow1 THEN 1 WHEN fast < slow AND fast1 >= slow1 THEN -1 ELSE 0 END AS signal FROM s1)")
COSTED = SURE.replace("SELECT symbol, entry_bar, bar_no AS exit_bar, was AS direction, round(entry, 6) AS entry, round(x, 6) AS exit FROM sim WHERE x IS NOT NULL", """, tr AS (SELECT symbol, entry_bar, bar_no AS exit_bar, round(((x / entry - 1) * was - 2 * 0.0002) * 1000000)::BIGINT AS net FROM sim WHERE x IS NOT NULL),
eq AS (SELECT *, 1000000 + sum(net) OVER w AS equity FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY exit_bar)), pk AS (SELECT *, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY exit_bar), 1000000) AS peak FROM eq)
SELECT symbol, count(*) AS n, count(*) FILTER (net > 0) AS wins, round(sum(net) / 1e6, 6) AS net, round(min((equity - peak) / 1e6), 6) AS drawdown FROM pk GROUP BY 1""")


@query("j02_costed_trades", COSTED)
def costed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracket trades on signals of enough confidence, less a commission at each end: what they earn by symbol, and the deepest fall."""
    sure = F.least(F.greatest(F.abs(F.col("close") - F.col("open")) / F.nullif(F.col("atr"), F.lit(0.0)), F.lit(0.1)), F.lit(0.95)) < 0.3
    b = signals(spark, sf_dir).withColumn("signal", F.when(sure, 0).otherwise(F.col("signal")))
    t = simulate.trades_of(b, ["symbol"], OHLC, simulate.bracket())
    t = t.withColumn("net", F.round(((F.col("exit") / F.col("entry") - 1) * F.col("direction") - 2 * 0.0002) * 1_000_000).cast("long"))
    w = W.partitionBy("symbol").orderBy("exit_bar").rowsBetween(W.unboundedPreceding, 0)  # trades of a series of bars
    e = t.withColumn("equity", 1_000_000 + F.sum("net").over(w)).withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(1_000_000)))
    return e.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("net") > 0).alias("wins"), F.round(F.sum("net") / 1_000_000, 6).alias("net"), F.round(F.min((F.col("equity") - F.col("peak")) / 1_000_000), 6).alias("drawdown"))


CLOSE_BASED = f"""WITH RECURSIVE {SIGNALS}, sg AS (SELECT *, {lag('signal')} AS s1, {lag('atr')} AS a1 FROM sig),
sim AS (SELECT symbol, bar_no, 0 AS pos, CAST(0 AS BIGINT) AS start, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS best, CAST(0 AS DOUBLE) AS a0, CAST(NULL AS VARCHAR) AS why, CAST(0 AS DOUBLE) AS x, 0 AS was FROM sg WHERE bar_no = 1
  UNION ALL SELECT symbol, bar_no, CASE WHEN pos <> 0 THEN CASE WHEN why IS NULL THEN pos ELSE 0 END WHEN s1 <> 0 THEN s1 ELSE 0 END, CASE WHEN pos = 0 AND s1 <> 0 THEN bar_no ELSE start END, CASE WHEN pos = 0 AND s1 <> 0 THEN open ELSE entry END,
  CASE WHEN pos = 0 AND s1 <> 0 THEN close * s1 ELSE top END, CASE WHEN pos = 0 AND s1 <> 0 THEN a1 ELSE a0 END, why, close, pos
  FROM (SELECT *, CASE WHEN pos = 0 THEN NULL WHEN (close / entry - 1) * pos <= -least(0.3, CASE WHEN a0 > 0 THEN 2 * a0 / entry ELSE 1e300 END) THEN 'stop' WHEN atr > 0 AND top - close * pos >= 3 * atr THEN 'trail' WHEN signal * pos < 0 THEN 'reversal' WHEN bar_no - start >= 12 THEN 'time' END AS why
    FROM (SELECT b.*, p.pos, p.start, p.entry, p.a0, greatest(p.best, b.close * p.pos) AS top FROM sim p JOIN sg b ON b.symbol = p.symbol AND b.bar_no = p.bar_no + 1)))
SELECT symbol, start AS entry_bar, bar_no AS exit_bar, was AS direction, round(entry, 6) AS entry, round(x, 6) AS exit, why AS reason FROM sim WHERE why IS NOT NULL"""

MANAGED = f"""WITH RECURSIVE {SIGNALS},
sim AS (SELECT symbol, bar_no, 0 AS pos, CAST(0 AS BIGINT) AS start, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS risk, CAST(0 AS DOUBLE) AS stop, false AS half, CAST(NULL AS VARCHAR) AS why, CAST(0 AS DOUBLE) AS x, 0 AS was FROM sig WHERE bar_no = 1
  UNION ALL SELECT symbol, bar_no, CASE WHEN pos <> 0 THEN CASE WHEN why IS NULL THEN pos ELSE 0 END WHEN opens THEN signal ELSE 0 END, CASE WHEN opens THEN bar_no ELSE start END, CASE WHEN opens THEN close ELSE entry END, CASE WHEN opens THEN atr ELSE risk END,
  CASE WHEN opens THEN close - signal * atr WHEN pos <> 0 AND half1 THEN pos * greatest(CASE WHEN half THEN stop ELSE entry END * pos, (best - pos * risk) * pos) ELSE stop END, NOT opens AND half1, why, CASE WHEN why IN ('stop', 'trail') THEN stop ELSE close END, pos
  FROM (SELECT *, CASE WHEN pos = 0 THEN NULL WHEN (worst - stop) * pos <= 0 THEN CASE WHEN half THEN 'trail' ELSE 'stop' END WHEN atr > 0 AND (open - close) * pos >= 3 * atr THEN 'shock' WHEN bar_no - start >= 20 THEN 'time' END AS why, pos <> 0 AND (half OR (best - entry) * pos >= risk) AS half1
    FROM (SELECT b.*, p.pos, p.start, p.entry, p.risk, p.stop, p.half, p.pos = 0 AND b.signal <> 0 AND b.atr > 0 AS opens, CASE WHEN p.pos > 0 THEN b.low ELSE b.high END AS worst, CASE WHEN p.pos > 0 THEN b.high ELSE b.low END AS best FROM sim p JOIN sig b ON b.symbol = p.symbol AND b.bar_no = p.bar_no + 1)))
SELECT symbol, start AS entry_bar, bar_no AS exit_bar, was AS direction, round(entry, 6) AS entry, round(x, 6) AS exit, why AS reason FROM sim WHERE why IS NOT NULL"""

PAPER = f"""WITH RECURSIVE {SIGNALS},
sim AS (SELECT symbol, bar_no, 0 AS pos, CAST(0 AS BIGINT) AS opened, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS risk, false AS half, CAST(NULL AS VARCHAR) AS reason FROM sig WHERE bar_no = 1
  UNION ALL SELECT symbol, bar_no, CASE WHEN pos <> 0 THEN CASE WHEN reason IS NULL THEN pos ELSE 0 END WHEN opens THEN signal ELSE 0 END, CASE WHEN opens THEN bar_no ELSE opened END, CASE WHEN opens THEN close ELSE entry END, CASE WHEN opens THEN atr ELSE risk END, pos <> 0 AND (half OR (best - entry) * pos >= risk), reason
  FROM (SELECT *, CASE WHEN pos = 0 THEN NULL WHEN (worst - CASE WHEN half THEN entry ELSE entry - pos * risk END) * pos <= 0 THEN CASE WHEN half THEN 'EVEN' ELSE 'STOP' END WHEN half AND (best - entry) * pos >= 2 * risk THEN 'TP2' END AS reason
    FROM (SELECT b.*, p.pos, p.opened, p.entry, p.risk, p.half, p.pos = 0 AND b.signal <> 0 AND b.atr > 0 AS opens, CASE WHEN p.pos > 0 THEN b.low ELSE b.high END AS worst, CASE WHEN p.pos > 0 THEN b.high ELSE b.low END AS best FROM sim p JOIN sig b ON b.symbol = p.symbol AND b.bar_no = p.bar_no + 1)))
SELECT symbol, opened, bar_no AS closed, reason, CASE reason WHEN 'STOP' THEN -1.0 WHEN 'EVEN' THEN 0.5 ELSE 1.5 END AS r FROM sim WHERE reason IS NOT NULL"""


def units_sql(strict: bool, refresh: int) -> str:
    """Trades of growing units by recursion over bars."""
    return f"""WITH RECURSIVE {SIGNALS}, sg AS (SELECT symbol, bar_no, close, signal, greatest(atr / close, 1e-6) AS a, lead(open) OVER (PARTITION BY symbol ORDER BY bar_no) AS o1, {full('min', 'close', 10, 1)} AS low10 FROM sig),
sim AS (SELECT DISTINCT symbol, 0::BIGINT AS bar_no, 0 AS side, 0::BIGINT AS start, 0 AS held, 0 AS units, 0::DOUBLE AS entry, 0::DOUBLE AS floor_, 0::DOUBLE AS best, 0::DOUBLE AS mark, NULL::VARCHAR AS why, 0 AS was, 0::BIGINT AS from_bar, 0 AS n, 0::DOUBLE AS mean, 0::DOUBLE AS x FROM sg
  UNION ALL SELECT symbol, bar_no, CASE WHEN opens THEN signal WHEN why IS NULL THEN side ELSE 0 END, CASE WHEN opens THEN bar_no + 1 ELSE start END, CASE WHEN opens THEN 0 ELSE held1 END, CASE WHEN opens THEN 1 WHEN grows THEN units + 1 ELSE units END,
    CASE WHEN opens THEN o1 WHEN grows THEN (entry * units + close) / (units + 1) ELSE entry END, CASE WHEN opens THEN o1 * (1 - signal * 2.0 * a) ELSE floor_ END, CASE WHEN opens THEN o1 ELSE best1 END, CASE WHEN opens THEN o1 * (1 + signal * 0.5 * a) WHEN grows THEN close * (1 + side * 0.5 * a) ELSE mark END, why, side, start, units, entry, close
  FROM (SELECT *, signal <> 0 AND o1 IS NOT NULL AND (side = 0 OR coalesce(why IN ('reversal', 'refresh'), false)) AS opens, side <> 0 AND why IS NULL AND units < 4 AND (close - mark) * side >= 0 AS grows
    FROM (SELECT *, CASE WHEN side = 0 THEN NULL WHEN (close - floor_) * side <= 0 THEN 'stop' WHEN (close - best1 * (1 - side * 3.0 * a)) * side <= 0 THEN 'trail' WHEN {str(strict).lower()} AND side > 0 AND close < low10 THEN 'donchian' WHEN signal * side < 0 THEN 'reversal' WHEN signal = side AND held1 >= {refresh} THEN 'refresh' WHEN NOT {str(strict).lower()} AND held1 >= 30 THEN 'time' END AS why
      FROM (SELECT b.*, p.side, p.start, p.held + 1 AS held1, p.units, p.entry, p.floor_, p.mark, CASE WHEN p.side > 0 THEN greatest(p.best, b.close) ELSE least(p.best, b.close) END AS best1 FROM sim p JOIN sg b ON b.symbol = p.symbol AND b.bar_no = p.bar_no + 1))))
SELECT symbol, from_bar AS entry_bar, bar_no AS exit_bar, was AS direction, n AS units, round(mean, 6) AS entry, round(x, 6) AS exit, why AS reason FROM sim WHERE why IS NOT NULL"""


def unit_trades(spark: SparkSession, sf_dir: str, strict: bool, refresh: int) -> DataFrame:
    b = signals(spark, sf_dir).withColumn("open1", F.lead("open").over(W.partitionBy("symbol").orderBy("bar_no"))).withColumn("low10", lowest("close", 10, 1))
    return rounded(simulate.trades_of(b, ["symbol"], ["open1", "close", "signal", "atr", "low10"], simulate.trend_units(strict=strict, refresh=refresh), simulate.UNIT_TRADES))


@query("j03_donchian_units", units_sql(True, 20))
def donchian_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades that add units and end at a close under the lowest of ten."""
    return unit_trades(spark, sf_dir, True, 20)


@query("j03_refreshed_units", units_sql(False, 5))
def refreshed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades that add units, end after a time, and are renewed by a signal of their own direction after five bars."""
    return unit_trades(spark, sf_dir, False, 5)


TWO_TARGETS = f"""WITH RECURSIVE {SIGNALS},
sim AS (SELECT DISTINCT symbol, 0::BIGINT AS bar_no, 0 AS side, 0::BIGINT AS start, 0::DOUBLE AS entry, 0::DOUBLE AS risk, 0::DOUBLE AS stop, 0::DOUBLE AS best, 0::DOUBLE AS gain, 0::DOUBLE AS loss, false AS met, NULL::VARCHAR AS why, 0::DOUBLE AS x, 0 AS was FROM sig
  UNION ALL SELECT symbol, bar_no, CASE WHEN opens THEN signal WHEN why IS NULL THEN side ELSE 0 END, CASE WHEN opens THEN bar_no ELSE start END, CASE WHEN opens THEN close ELSE entry END, CASE WHEN opens THEN atr ELSE risk END, CASE WHEN opens THEN close - signal * atr ELSE stop2 END, CASE WHEN opens THEN close ELSE best1 END, CASE WHEN opens THEN 0 ELSE gain1 END, CASE WHEN opens THEN 0 ELSE loss1 END, NOT opens AND met1, why, CASE why WHEN 'stop' THEN stop WHEN 'target' THEN entry + side * 2.5 * risk ELSE close END, side
  FROM (SELECT *, side = 0 AND signal <> 0 AND atr > 0 AS opens, CASE WHEN side = 0 THEN NULL WHEN (worst - stop) * side <= 0 THEN 'stop' WHEN high - low > 2.5 * atr AND (entry - close) * side > atr THEN 'shock' WHEN (good - entry) * side >= risk AND (good - entry) * side >= 2.5 * risk THEN 'target' WHEN bar_no - start > 24 AND loss1 > 2.5 * atr AND gain1 < abs(entry - stop2) THEN 'stagnation' END AS why
    FROM (SELECT *, CASE WHEN met1 THEN greatest(stop1 * side, (best1 - side * 1.5 * atr) * side) * side ELSE stop1 END AS stop2
      FROM (SELECT *, met OR (good - entry) * side >= risk AS met1, CASE WHEN (good - entry) * side >= risk THEN greatest(stop * side, entry * side) * side ELSE stop END AS stop1, greatest(best * side, good * side) * side AS best1, greatest(gain, (good - entry) * side) AS gain1, greatest(loss, (entry - worst) * side) AS loss1
        FROM (SELECT b.*, p.side, p.start, p.entry, p.risk, p.stop, p.best, p.gain, p.loss, p.met, CASE WHEN p.side > 0 THEN b.low ELSE b.high END AS worst, CASE WHEN p.side > 0 THEN b.high ELSE b.low END AS good FROM sim p JOIN sig b ON b.symbol = p.symbol AND b.bar_no = p.bar_no + 1)))))
SELECT symbol, start AS entry_bar, bar_no AS exit_bar, was AS direction, round(entry, 6) AS entry, round(x, 6) AS exit, why AS reason FROM sim WHERE why IS NOT NULL"""


@query("j20_two_targets", TWO_TARGETS)
def two_target_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.trades_of(signals(spark, sf_dir), ["symbol"], ["high", "low", "close", "signal", "atr"], simulate.two_targets()))


@query("j03_close_based", CLOSE_BASED)
def close_based(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.trades_of(signals(spark, sf_dir), ["symbol"], ["open", "close", "signal", "atr"], simulate.close_based()))


@query("j04_limit_entry")
def limit_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.trades_of(signals(spark, sf_dir), ["symbol"], ["high", "low", "close", "signal", "atr"], simulate.limit_entry()))


@query("j20_managed_trades", MANAGED)
def managed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulate.trades_of(signals(spark, sf_dir), ["symbol"], OHLC, simulate.managed()))


@query(
    "j06_portfolio",
    f"WITH {TRADES}, d AS (SELECT exit_ts::DATE AS day, sum(pnl) / 1000 AS pnl, count(*) AS n FROM trades GROUP BY 1), e AS (SELECT day, n, 100000 + sum(pnl) OVER (ORDER BY day) AS equity FROM d), p AS (SELECT *, greatest(max(equity) OVER (ORDER BY day), 100000) AS peak FROM e) SELECT day, n, round(equity, 4) AS equity, round((equity - peak) / peak * 100, 6) AS drawdown_pct FROM p",
)
def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account over all symbols: results are summed by day first, and the running equity is over days alone."""
    d = trades(spark, sf_dir).groupBy(F.to_date("exit_ts").alias("day")).agg((F.sum("pnl") / 1000).alias("pnl"), F.count("*").alias("n"))
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    e = d.withColumn("equity", 100_000 + F.sum("pnl").over(w)).withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(100_000.0)))
    return e.select("day", "n", F.round("equity", 4).alias("equity"), F.round((F.col("equity") - F.col("peak")) / F.col("peak") * 100, 6).alias("drawdown_pct"))


SHARED = bracket_sql().replace("WITH RECURSIVE ", "WITH RECURSIVE ", 1).replace("SELECT symbol, entry_bar, bar_no AS exit_bar, was AS direction, round(entry, 6) AS entry, round(x, 6) AS exit FROM sim WHERE x IS NOT NULL", """, tr AS (SELECT symbol, entry_bar, bar_no AS exit_bar, (x / entry - 1) * was AS ret FROM sim WHERE x IS NOT NULL), nu AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS i FROM (SELECT DISTINCT symbol FROM tr)),
ev AS (SELECT a.ts AS step, i, NULL::DOUBLE AS ret FROM tr JOIN nu USING (symbol) JOIN bars a ON a.symbol = tr.symbol AND a.bar_no = entry_bar UNION ALL SELECT z.ts, i, ret FROM tr JOIN nu USING (symbol) JOIN bars z ON z.symbol = tr.symbol AND z.bar_no = exit_bar),
st AS (SELECT step, row_number() OVER (ORDER BY step) AS k, coalesce(list({'i': i, 'ret': ret}) FILTER (ret IS NOT NULL), []) AS outs, coalesce(list(i) FILTER (ret IS NULL), []) AS ins FROM ev GROUP BY 1),
fold AS (SELECT 0::BIGINT AS k, NULL::TIMESTAMP AS step, 100000::DOUBLE AS equity, list_transform(range((SELECT count(*) FROM nu)), lambda i: 0::DOUBLE) AS held, 100000::DOUBLE AS peak
  UNION ALL SELECT k, step, e, list_transform(range(1, len(held) + 1), lambda i: CASE WHEN list_contains(ins, i) THEN 0.25 * e WHEN list_contains(list_transform(outs, lambda o: o.i), i) THEN 0.0 ELSE held[i] END), greatest(peak, e)
  FROM (SELECT s.k, s.step, outs, ins, held, peak, equity + coalesce(list_sum(list_transform(outs, lambda o: o.ret * held[o.i])), 0) AS e FROM fold f JOIN st s ON s.k = f.k + 1))
SELECT step, round(equity, 4) AS equity, len(list_filter(held, lambda x: x <> 0))::INTEGER AS n_open, round(equity / peak - 1, 6) AS drawdown FROM fold WHERE k > 0""")


@query("j21_shared_equity", SHARED)
def shared_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols' trades on one account, each sized by a quarter of what the account has when it is opened."""
    b = staged(signals(spark, sf_dir, "ts"), "signals")
    t = simulate.trades_of(b, ["symbol"], OHLC, simulate.bracket())
    at = b.select("symbol", "bar_no", "ts")
    t = t.join(at.select("symbol", F.col("bar_no").alias("entry_bar"), F.col("ts").alias("opened")), ["symbol", "entry_bar"]).join(at.select("symbol", F.col("bar_no").alias("exit_bar"), F.col("ts").alias("closed")), ["symbol", "exit_bar"])
    t = t.select("symbol", "opened", "closed", ((F.col("exit") / F.col("entry") - 1) * F.col("direction")).alias("ret"))
    return account.drawdown(account.shared_equity(t)).select("step", F.round("equity", 4).alias("equity"), "n_open", F.round("drawdown", 6).alias("drawdown"))


@query("j08_challenge")
def challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy and regime as an account, a day a step."""
    d = trades(spark, sf_dir).groupBy("strategy", "regime", F.datediff(F.to_date("exit_ts"), F.lit("1990-01-01").cast("date")).cast("long").alias("bar_no")).agg((F.sum("pnl") / 5).alias("pnl"))
    out = simulate.trades_of(d, ["strategy", "regime"], ["pnl"], simulate.challenge(), simulate.CHALLENGE)
    return out.withColumn("balance", F.round("balance", 4)).withColumn("floor", F.round("floor", 4))


CAPPED = f"""WITH RECURSIVE {TRADES}, d AS (SELECT strategy, regime, exit_ts::DATE AS day, round(sum(r) / 5, 6) AS x FROM trades GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY strategy, regime ORDER BY day) AS k, count(*) OVER (PARTITION BY strategy, regime) AS last FROM d),
sim AS (SELECT DISTINCT strategy, regime, 0::BIGINT AS k, 100000::DOUBLE AS balance, 100000::DOUBLE AS high, 94000::DOUBLE AS lowest, 94000::DOUBLE AS next_lowest, 'go' AS outcome FROM n
  UNION ALL SELECT strategy, regime, k, b, greatest(high, b), lowest, least(100000, greatest(lowest, greatest(high, b) - 6000)), CASE WHEN b <= lowest THEN 'bust' WHEN b >= 108000 THEN 'pass' WHEN k = last THEN 'open' ELSE 'go' END
  FROM (SELECT n.strategy, n.regime, n.k, n.last, p.high, p.next_lowest AS lowest, p.balance + n.x * least(1000, 0.25 * (p.balance - p.next_lowest)) AS b FROM sim p JOIN n ON n.strategy = p.strategy AND n.regime = p.regime AND n.k = p.k + 1 WHERE p.outcome = 'go'))
SELECT strategy, regime, k AS days, round(balance, 4) AS balance, round(CASE WHEN outcome = 'open' THEN next_lowest ELSE lowest END, 4) AS floor, outcome FROM sim WHERE outcome <> 'go'"""


@query("j08_capped_risk", CAPPED)
def capped_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy and regime as an account whose risk shrinks with its distance from the floor."""
    day = F.datediff(F.to_date("exit_ts"), F.lit("1990-01-01").cast("date")).cast("long").alias("bar_no")
    d = trades(spark, sf_dir).groupBy("strategy", "regime", day).agg(F.round(F.sum("r") / 5, 6).alias("x"))
    out = simulate.trades_of(d, ["strategy", "regime"], ["x"], simulate.capped_challenge(), simulate.CHALLENGE)
    return out.withColumn("balance", F.round("balance", 4)).withColumn("floor", F.round("floor", 4))


LEGAL = [("F", "F"), ("F", "O"), ("O", "O")]


@query("j09_transitions", f"WITH s AS (SELECT o_orderkey, l_linenumber, l_shipdate, l_linestatus AS state, lag(l_linestatus) OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS before FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT before, state, count(*) AS n, (before, state) IN ({', '.join(f'({a!r}, {b!r})' for a, b in LEGAL)}) AS legal FROM s WHERE before IS NOT NULL GROUP BY ALL")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each state against the one before, by a table of legal transitions."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    w = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    s = line.select(F.col("l_linestatus").alias("state"), F.lag("l_linestatus").over(w).alias("before")).where("before is not null")
    legal = F.broadcast(spark.createDataFrame([(a, b, True) for a, b in LEGAL], "before string, state string, legal boolean"))
    return s.groupBy("before", "state").agg(F.count("*").alias("n")).join(legal, ["before", "state"], "left").withColumn("legal", F.coalesce("legal", F.lit(False)))


SIMS = 40
WHOLE_SIMS = 1000  # of the queries named so
DAILY = f"{TRADES}, d AS (SELECT strategy, exit_ts::DATE AS day, round(sum(pnl) / 500, 6) AS x FROM trades GROUP BY ALL)"


def resampled_sql(sims: int) -> str:
    return f"{DAILY}, k AS (SELECT strategy, x, row_number() OVER (PARTITION BY strategy ORDER BY x) - 1 AS at_no, count(*) OVER (PARTITION BY strategy) AS n FROM d), q AS (SELECT strategy, at_no AS step, n, unnest(range({sims})) AS sim FROM k), r AS (SELECT strategy, step, sim, ('0x' || substr(md5('7/' || strategy || '/' || sim || '/' || step), 1, 12))::BIGINT % n AS at_no FROM q), v AS (SELECT r.strategy, sim, step, x FROM r JOIN k USING (strategy, at_no))"


def bound_sql(sims: int) -> str:
    return f"WITH {resampled_sql(sims)}, e AS (SELECT strategy, sim, step, sum((x * 1000000)::BIGINT) OVER (PARTITION BY strategy, sim ORDER BY step) AS eq FROM v), h AS (SELECT strategy, sim, min(step) FILTER (eq >= 3000000) AS hit, min(step) FILTER (eq <= -3000000) AS bust FROM e GROUP BY ALL) SELECT strategy, count(*) AS sims, count(*) FILTER (hit IS NOT NULL AND (bust IS NULL OR hit < bust)) AS passed, count(*) FILTER (bust IS NOT NULL AND (hit IS NULL OR bust < hit)) AS failed FROM h GROUP BY 1"


def flips_sql(sims: int) -> str:
    return f"WITH {DAILY}, k AS (SELECT strategy, day, (x * 1000000)::BIGINT AS x, row_number() OVER (PARTITION BY strategy ORDER BY day) AS i FROM d), p AS (SELECT strategy, i, x, unnest(range({sims})) AS sim FROM k), s AS (SELECT strategy, sim, sum(CASE WHEN ('0x' || substr(md5('11/' || strategy || '/' || sim || '/' || i), 1, 12))::BIGINT % 2 = 0 THEN x ELSE -x END) AS mu FROM p GROUP BY ALL), o AS (SELECT strategy, sum(x) AS observed, count(*) AS n FROM k GROUP BY 1) SELECT strategy, round(any_value(observed / n) / 1e6, 6) AS observed, round(avg((mu >= observed)::INT), 6) AS p FROM s JOIN o USING (strategy) GROUP BY 1"


def difference_sql(sims: int) -> str:
    return f"WITH {resampled_sql(sims)}, mu AS (SELECT strategy, sim, avg(x) AS mu FROM v GROUP BY ALL), j AS (SELECT a.sim, a.mu - b.mu AS diff FROM mu a JOIN mu b USING (sim) WHERE a.strategy = 'A' AND b.strategy = 'N') SELECT count(*) AS sims, round(avg((diff <= 0)::INT), 6) AS p, round(avg(diff), 6) AS mean FROM j"


def every_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).groupBy("strategy", F.to_date("exit_ts").alias("day")).agg(F.round(F.sum("pnl") / 500, 6).alias("x"))


@query("j10_bootstrap", bound_sql(SIMS))
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled paths of the whole ledger and which bound they reach first; the rest are incomplete."""
    return first_bound(every_day(spark, sf_dir), SIMS)


@query("j10_bootstrap_whole", bound_sql(WHOLE_SIMS))
def bootstrap_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_bound(every_day(spark, sf_dir), WHOLE_SIMS)


def first_bound(d: DataFrame, sims: int) -> DataFrame:
    v = simulate.resampled(d, "x", "strategy", sims)
    w = W.partitionBy("strategy", "sim").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    e = v.withColumn("eq", F.sum(F.round(F.col("x") * 1_000_000).cast("long")).over(w))  # whole millionths, so that no bound is met by rounding
    h = e.groupBy("strategy", "sim").agg(F.min(F.when(F.col("eq") >= 3_000_000, F.col("step"))).alias("hit"), F.min(F.when(F.col("eq") <= -3_000_000, F.col("step"))).alias("bust"))
    passed, failed = F.col("hit") < F.coalesce("bust", F.lit(1 << 40)), F.col("bust") < F.coalesce("hit", F.lit(1 << 40))
    return h.groupBy("strategy").agg(F.count("*").alias("sims"), F.count_if(passed).alias("passed"), F.count_if(failed).alias("failed"))


@query("j11_permutation", flips_sql(SIMS))
def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of sign-flipped series whose mean is at least the real one."""
    return sign_flips(every_day(spark, sf_dir), SIMS)


@query("j11_permutation_whole", flips_sql(WHOLE_SIMS))
def permutation_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sign_flips(every_day(spark, sf_dir), WHOLE_SIMS)


def sign_flips(d: DataFrame, sims: int) -> DataFrame:
    d = d.withColumn("i", F.row_number().over(W.partitionBy("strategy").orderBy("day"))).withColumn("x", F.round(F.col("x") * 1_000_000).cast("long"))
    p = d.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    flip = simulate.draw(F.lit(2), 11, F.col("strategy"), F.col("sim"), F.col("i")) == 0
    s = p.groupBy("strategy", "sim").agg(F.sum(F.when(flip, F.col("x")).otherwise(-F.col("x"))).alias("mu"))
    j = s.join(d.groupBy("strategy").agg(F.sum("x").alias("observed"), F.count("*").alias("n")), "strategy")
    return j.groupBy("strategy").agg(F.round(F.any_value(F.col("observed") / F.col("n")) / 1_000_000, 6).alias("observed"), F.round(F.avg((F.col("mu") >= F.col("observed")).cast("int")), 6).alias("p"))


ENTRIES = f"""{SIGNALS.replace("SELECT symbol, bar_no, open, high, low, close, coalesce(atr, 0) AS atr,", "SELECT symbol, bar_no, open, high, low, close, coalesce(atr, 0) AS atr, CASE WHEN fast >= slow THEN 1 ELSE -1 END AS side,")},
f AS (SELECT *, count(*) OVER n AS ahead, list(close) OVER n AS nx FROM sig WINDOW n AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
g AS (SELECT *, list_transform(nx, lambda x: (x - close) * side / atr) AS rs FROM f WHERE atr > 0 AND ahead = 10),
h AS (SELECT *, list_position(list_transform(rs, lambda x: x >= 1.5), true) AS up, list_position(list_transform(rs, lambda x: x <= -1), true) AS down FROM g),
el AS (SELECT symbol, bar_no, signal, round(CASE WHEN coalesce(up, 0) > 0 AND (coalesce(down, 0) = 0 OR up <= down) THEN 1.5 WHEN coalesce(down, 0) > 0 THEN -1 ELSE rs[10] END, 6) AS r FROM h)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar at which a trade could be entered, with the result in ranges of one in the direction of the trend, by the same exits as all."""
    w = W.partitionBy("symbol").orderBy("bar_no").rowsBetween(1, 10)
    b = signals(spark, sf_dir, "fast", "slow").withColumn("side", F.when(F.col("fast") >= F.col("slow"), 1).otherwise(-1))
    f = b.withColumn("nx", F.collect_list("close").over(w)).where((F.col("atr") > 0) & (F.size("nx") == 10))
    rs = F.transform("nx", lambda x: (x - F.col("close")) * F.col("side") / F.col("atr"))
    up, down = F.array_position(F.transform("rs", lambda x: x >= 1.5), F.lit(True)), F.array_position(F.transform("rs", lambda x: x <= -1), F.lit(True))
    f = f.withColumn("rs", rs).withColumn("up", up).withColumn("down", down)
    r = F.when((F.col("up") > 0) & ((F.col("down") == 0) | (F.col("up") <= F.col("down"))), 1.5).when(F.col("down") > 0, -1.0).otherwise(F.col("rs")[9])
    return f.select("symbol", "bar_no", "signal", F.round(r, 6).alias("r"))


@query(
    "j11_random_entries",
    f"WITH {ENTRIES}, s AS (SELECT symbol, count(*) AS k, sum((r * 1000000)::BIGINT) AS real FROM el WHERE signal <> 0 GROUP BY 1), p AS (SELECT symbol, bar_no, (r * 1000000)::BIGINT AS x, unnest(range({WHOLE_SIMS})) AS sim FROM el WHERE symbol IN (SELECT symbol FROM s)), u AS (SELECT symbol, sim, x, row_number() OVER (PARTITION BY symbol, sim ORDER BY ('0x' || substr(md5('11/' || symbol || '/' || sim || '/' || bar_no), 1, 12))::BIGINT % {drawing.RANGE}, bar_no) AS place FROM p), d AS (SELECT symbol, sim, sum(x) AS total FROM u JOIN s USING (symbol) WHERE place <= k GROUP BY ALL), o AS (SELECT sim, sum(total) AS total FROM d GROUP BY 1), t AS (SELECT sum(real) AS real, sum(k) AS n FROM s) SELECT any_value(n)::BIGINT AS n, round(any_value(real / n) / 1e6, 6) AS observed, round(avg(total / n) / 1e6, 6) AS null_mean, round(avg((total >= real)::INT), 6) AS p FROM o, t",
)
def random_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether signals pick better bars than chance: as many bars of each symbol, drawn a thousand times from all that could be entered."""
    e = staged(entries(spark, sf_dir).withColumn("x", F.round(F.col("r") * 1_000_000)), "entries")
    fired = e.where("signal <> 0").groupBy("symbol").agg(F.count("*").alias("k"), F.sum("x").alias("real"))
    drawn = drawing.sums_of_draws(e, fired, "x", "bar_no", "symbol", WHOLE_SIMS).groupBy("sim").agg(F.sum("total").alias("total"))
    real = fired.agg(F.sum("real").alias("real"), F.sum("k").alias("n"))
    each = drawn.join(F.broadcast(real))
    mean = lambda c: F.round(c / F.any_value("n") / 1_000_000, 6)
    return each.agg(F.any_value("n").alias("n"), mean(F.any_value("real")).alias("observed"), mean(F.avg("total")).alias("null_mean"), F.round(F.avg((F.col("total") >= F.col("real")).cast("int")), 6).alias("p"))


@query("j12_bootstrap_difference", difference_sql(SIMS))
def bootstrap_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference(every_day(spark, sf_dir), SIMS)


@query("j12_bootstrap_difference_whole", difference_sql(WHOLE_SIMS))
def bootstrap_difference_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference(every_day(spark, sf_dir), WHOLE_SIMS)


def difference(d: DataFrame, sims: int) -> DataFrame:
    v = simulate.resampled(d.where(F.col("strategy").isin("A", "N")), "x", "strategy", sims)
    j = v.groupBy("sim").agg((F.avg(F.when(F.col("strategy") == "A", F.col("x"))) - F.avg(F.when(F.col("strategy") == "N", F.col("x")))).alias("diff"))
    return j.where("diff is not null").agg(F.count("*").alias("sims"), F.round(F.avg((F.col("diff") <= 0).cast("int")), 6).alias("p"), F.round(F.avg("diff"), 6).alias("mean"))


STOPS, REWARDS = (1.0, 1.5, 2.0), (1.0, 2.0, 3.0)
RANDOM = 20_000  # pairs of parameters of the random sweep


def swept(made: DataFrame) -> DataFrame:
    factor = F.when(F.col("loss") > 0, F.least(F.col("gain") / F.nullif(F.col("loss"), F.lit(0.0)), F.lit(999.0))).when(F.col("gain") > 0, 999.0).otherwise(0.0)
    return made.select("symbol", "stop_mult", "reward", F.col("n").cast("long").alias("n"), F.round(F.col("wins") / F.col("n"), 6).alias("win_rate"), F.round("total", 6).alias("total"), F.round(factor, 6).alias("profit_factor"))


GRID_SQL = " UNION ALL ".join(f"SELECT *, CAST({a} AS DOUBLE) AS stop_mult, CAST({b} AS DOUBLE) AS reward FROM ({bracket_sql(stop=a, reward=b)})".replace("round(entry, 6) AS entry, round(x, 6) AS exit", "entry, x AS exit") for a in STOPS for b in REWARDS)


@query(
    "j13_sweep",
    f"WITH t AS ({GRID_SQL}), r AS (SELECT symbol, stop_mult, reward, (exit / entry - 1) * direction AS ret FROM t) SELECT symbol, stop_mult, reward, count(*) AS n, round(avg((ret > 0)::INT), 6) AS win_rate, round(sum(ret), 6) AS total, round(least(coalesce(sum(greatest(ret, 0)) / nullif(-sum(least(ret, 0)), 0), CASE WHEN sum(greatest(ret, 0)) > 0 THEN 999 ELSE 0 END), 999), 6) AS profit_factor FROM r GROUP BY ALL",
)
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol under every pair of parameters; a pair is one backtest."""
    grid = spark.createDataFrame([(a, b) for a in STOPS for b in REWARDS], "stop_mult double, reward double")
    return swept(simulate.sweep(signals(spark, sf_dir), grid))


@query("j13_random_sweep")
def random_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol under thousands of pairs drawn by hash: stops of 0.5 to 3 ranges, rewards of 0.5 to 5 risks."""
    part = lambda low, high, seed: F.lit(low) + F.lit(high - low) * simulate.draw(F.lit(1_000_000), seed, F.col("id")) / 1_000_000
    pairs = spark.range(RANDOM).select(part(0.5, 3.0, 21).alias("stop_mult"), part(0.5, 5.0, 22).alias("reward"))
    return swept(simulate.sweep(signals(spark, sf_dir), pairs))


@query("j14_walk_windows", "WITH b AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders), s AS (SELECT unnest(generate_series(0, 200)) AS k, a, z FROM b), w AS (SELECT a + CAST(k * 90 AS INTEGER) AS train_start, a + CAST(k * 90 + 360 AS INTEGER) AS test_start, a + CAST(k * 90 + 450 AS INTEGER) AS test_end, z FROM s) SELECT train_start, test_start, test_end FROM w WHERE test_end <= z")
def walk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling windows of twelve months of thirty days to train and three to test, three months apart."""
    span = table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("z"))
    s = span.select("a", F.explode(F.sequence(F.lit(0), F.floor((F.datediff("z", "a") - 450) / 90).cast("int"))).alias("k"))
    return s.select(F.expr("date_add(a, k * 90)").alias("train_start"), F.expr("date_add(a, k * 90 + 360)").alias("test_start"), F.expr("date_add(a, k * 90 + 450)").alias("test_end"))


@query(
    "j15_triple_barrier",
    f"WITH {SIGNALS}, f AS (SELECT symbol, bar_no, close, atr, list(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nx FROM sig), g AS (SELECT symbol, bar_no, list_position(list_transform(nx, lambda x: x >= close + 1.5 * atr), true) AS up, list_position(list_transform(nx, lambda x: x <= close - atr), true) AS down FROM f WHERE atr > 0) SELECT symbol, bar_no, CASE WHEN coalesce(up, 0) > 0 AND (coalesce(down, 0) = 0 OR up <= down) THEN 1 WHEN coalesce(down, 0) > 0 THEN -1 END AS label FROM g",
)
def triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of both bounds the next ten closes reach first (the upper one at a tie); null for neither."""
    w = W.partitionBy("symbol").orderBy("bar_no").rowsBetween(1, 10)
    f = signals(spark, sf_dir).withColumn("nx", F.collect_list("close").over(w)).where("atr > 0")
    up = F.array_position(F.transform("nx", lambda x: x >= F.col("close") + 1.5 * F.col("atr")), F.lit(True))
    down = F.array_position(F.transform("nx", lambda x: x <= F.col("close") - F.col("atr")), F.lit(True))
    return f.select("symbol", "bar_no", F.when((up > 0) & ((down == 0) | (up <= down)), 1).when(down > 0, -1).alias("label"))


@query("j17_failure_ladder", f"WITH {TRADES} SELECT trade_id, line_no, notional, CASE WHEN r > 0 THEN 'win' WHEN date_diff('day', entry_ts, exit_ts) < 10 THEN 'early stop' WHEN quantity > 40 THEN 'oversized' WHEN r < -1.5 THEN 'gap' WHEN regime LIKE '5%' THEN 'weak regime' ELSE 'noise' END AS reason FROM trades")
def failure_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("r") > 0, "win").when(F.datediff("exit_ts", "entry_ts") < 10, "early stop").when(F.col("quantity") > 40, "oversized").when(F.col("r") < -1.5, "gap").when(F.col("regime").startswith("5"), "weak regime").otherwise("noise")
    return trades(spark, sf_dir).select("trade_id", "line_no", "notional", reason.alias("reason"))


@query("j18_excursions", f"WITH {SIGNALS}, e AS (SELECT symbol, bar_no AS entry, close AS price, signal AS side FROM sig WHERE signal <> 0) SELECT e.symbol, entry, side, round(max(CASE WHEN side > 0 THEN high - price ELSE price - low END), 6) AS mfe, round(max(CASE WHEN side > 0 THEN price - low ELSE high - price END), 6) AS mae FROM e JOIN sig b ON b.symbol = e.symbol AND b.bar_no BETWEEN entry AND entry + 8 GROUP BY ALL")
def excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst price of each trade's life."""
    s = signals(spark, sf_dir)
    e = s.where("signal <> 0").select("symbol", F.col("bar_no").alias("entry"), F.col("close").alias("price"), F.col("signal").alias("side"))
    long_ = F.col("side") > 0
    best, worst = F.when(long_, F.col("high") - F.col("price")).otherwise(F.col("price") - F.col("low")), F.when(long_, F.col("price") - F.col("low")).otherwise(F.col("high") - F.col("price"))
    out = asof.window_join(e, s.select("symbol", "bar_no", "high", "low"), ["symbol"], "entry", 8, [F.round(F.max(best), 6).alias("mfe"), F.round(F.max(worst), 6).alias("mae")])
    return out.select("symbol", "entry", "side", "mfe", "mae")


@query(
    "j19_position_series",
    f"WITH {BARS}, p AS (SELECT symbol, bar_no, close / {lag('close')} - 1 AS ret, sign({lag('close')} - {lag('close', 4)}) AS pos FROM bars), q AS (SELECT symbol, ret, coalesce(pos, 0) AS pos, coalesce(pos, 0) * ret - CASE WHEN coalesce(pos, 0) <> 0 THEN 0.0002 ELSE 0 END AS x FROM p WHERE ret IS NOT NULL) SELECT symbol, count(*) FILTER (pos <> 0) AS active, round(sum(x), 5) AS total, round(avg(x) / nullif(stddev_samp(x), 0) * sqrt(252), 5) AS sharpe FROM q GROUP BY 1",
)
def position_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position known the bar before, times the bar's return, less a cost on bars with a position."""
    p = bars(spark, sf_dir).select("symbol", (F.col("close") / prev("close") - 1).alias("ret"), F.coalesce(F.signum(prev("close") - prev("close", 4)), F.lit(0.0)).alias("pos")).where("ret is not null")
    q = p.withColumn("x", F.col("pos") * F.col("ret") - F.when(F.col("pos") != 0, 0.0002).otherwise(0.0))
    return q.groupBy("symbol").agg(F.count_if(F.col("pos") != 0).alias("active"), F.round(F.sum("x"), 5).alias("total"), F.round(m.safe(F.avg("x"), F.stddev_samp("x")) * F.sqrt(F.lit(252.0)), 5).alias("sharpe"))


@query(
    "j22_reversion_label",
    f"WITH {SIGNALS}, f AS (SELECT symbol, bar_no, lead(open) OVER (PARTITION BY symbol ORDER BY bar_no) AS entry, {full('avg', 'close', 20)} AS mu, atr, count(close) OVER n AS k, max(high) OVER n AS hi, min(low) OVER n AS lo FROM sig WINDOW n AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) SELECT symbol, bar_no, CASE WHEN k < 6 OR mu IS NULL THEN NULL WHEN entry < mu THEN (lo > entry - 2 * atr AND hi >= entry + 0.6 * (mu - entry))::INT ELSE (hi < entry + 2 * atr AND lo <= entry - 0.6 * (entry - mu))::INT END AS label FROM f",
)
def reversion_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 if the next six bars go 60 % of the way back to the mean without reaching the stop."""
    w = W.partitionBy("symbol").orderBy("bar_no").rowsBetween(1, 6)
    f = signals(spark, sf_dir).select("symbol", "bar_no", "atr", F.lead("open").over(W.partitionBy("symbol").orderBy("bar_no")).alias("entry"), mean("close", 20).alias("mu"), F.count("close").over(w).alias("k"), F.max("high").over(w).alias("hi"), F.min("low").over(w).alias("lo"))
    e, mu, a = F.col("entry"), F.col("mu"), F.col("atr")
    below = ((F.col("lo") > e - 2 * a) & (F.col("hi") >= e + 0.6 * (mu - e))).cast("int")
    above = ((F.col("hi") < e + 2 * a) & (F.col("lo") <= e - 0.6 * (e - mu))).cast("int")
    return f.select("symbol", "bar_no", F.when((F.col("k") < 6) | mu.isNull(), None).when(e < mu, below).otherwise(above).alias("label"))

"""Aggregations over the trade ledger and over ticks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators import blocks, order_stats
from tapewright.operators import metrics as m
from tapewright.plans.registry import Registry
from tapewright.plans.sql import BARS, TICKS, TRADES
from tapewright.sources.market import IN_ORDER, bars, ticks, trades
from tapewright.sources.staging import staged

query = Registry()
QUERIES, SQL = query.queries, query.sql
IN_ORDER_SQL = ", ".join(IN_ORDER)
DAYS = "date_trunc('day', exit_ts)"


def summary_sql(keys: str, source: str = "trades", extra: str = "") -> str:
    return f"""WITH {TRADES}{extra} SELECT {keys}, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate,
      round(sum(pnl), 4) AS total, round(avg(pnl), 6) AS mean,
      round(CASE WHEN sum(least(pnl, 0)) < 0 THEN sum(greatest(pnl, 0)) / -sum(least(pnl, 0)) END, 6) AS profit_factor
      FROM {source} WHERE pnl IS NOT NULL GROUP BY ALL"""


def short(name: str) -> str:
    return f"WITH {TRADES} {name}"


@query("e01_by_regime", summary_sql("regime"))
def by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.summary(trades(spark, sf_dir), ["regime"])


@query("e02_by_weekday", summary_sql("isodow(exit_ts)::INT AS weekday"))
def by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.summary(trades(spark, sf_dir).withColumn("weekday", F.weekday("exit_ts") + 1), ["weekday"])


@query("e02_ticks_by_hour", f"WITH {TICKS} SELECT hour(ts)::INT AS hour, count(*) AS n, round(avg(price), 6) AS mean FROM ticks GROUP BY 1")
def by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean"))


@query("e03_by_strategy", summary_sql("strategy"))
def by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.summary(trades(spark, sf_dir), ["strategy"])


@query(
    "e04_best_setup",
    f"WITH {TRADES}, g AS (SELECT strategy, regime, CASE WHEN count(*) >= 5 THEN avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) ELSE 0 END AS s FROM trades GROUP BY ALL) SELECT strategy, regime, round(s, 6) AS score FROM g ORDER BY s DESC, strategy, regime LIMIT 1",
)
def best_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setups of under five trades score zero and stay in the comparison."""
    g = trades(spark, sf_dir).groupBy("strategy", "regime").agg(F.when(F.count("*") >= 5, m.win_rate("pnl")).otherwise(0.0).alias("s"))
    return g.orderBy(F.desc("s"), "strategy", "regime").limit(1).select("strategy", "regime", F.round("s", 6).alias("score"))


@query(
    "e05_cube_cells",
    f"""WITH {TRADES} SELECT coalesce(system, 'ALL') AS system, coalesce(regime, 'ALL') AS regime, coalesce(strategy, 'ALL') AS strategy, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate,
    round(CASE WHEN count(*) >= 5 THEN coalesce(avg(r) / nullif(stddev_samp(r), 0), 0) ELSE 0 END, 6) AS sharpe, count(*) >= 10 AS reliable FROM trades GROUP BY CUBE (system, regime, strategy)""",
)
def cube_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.cells(trades(spark, sf_dir), ["system", "regime", "strategy"])


@query(
    "e06_inference_table",
    f"""WITH {TRADES}, b AS (SELECT *, CASE WHEN quantity > 0 AND quantity <= 10 THEN 0 WHEN quantity > 10 AND quantity <= 25 THEN 1 WHEN quantity > 25 AND quantity <= 999 THEN 2 END AS bucket FROM trades),
    g AS (SELECT strategy, system, regime, bucket, count(*) AS n, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win_rate,
      least(coalesce(CASE WHEN sum(least(r, 0)) < 0 THEN sum(greatest(r, 0)) / -sum(least(r, 0)) END, CASE WHEN sum(greatest(r, 0)) > 0 THEN 999.0 ELSE 0 END), 999.0) AS pf FROM b GROUP BY ALL)
    SELECT strategy, system, regime, bucket, n, round(win_rate, 6) AS win_rate, round(pf, 6) AS profit_factor, pf > 1.5 AND n >= 30 AS recommend, pf < 0.8 AND n >= 30 AS avoid FROM g""",
)
def inference_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("bucket", m.bucketed(F.col("quantity"), [0, 10, 25, 999]))
    g = t.groupBy("strategy", "system", "regime", "bucket").agg(F.count("*").alias("n"), m.win_rate("r").alias("win_rate"), m.profit_factor("r", 999.0).alias("pf"))
    many = F.col("n") >= 30
    return g.select("strategy", "system", "regime", "bucket", "n", F.round("win_rate", 6).alias("win_rate"), F.round("pf", 6).alias("profit_factor"), ((F.col("pf") > 1.5) & many).alias("recommend"), ((F.col("pf") < 0.8) & many).alias("avoid"))


MODES = "stop_hit time_exit slippage reversal gap".split()
MODE_SQL = "CASE WHEN r < -1.5 THEN 'gap' WHEN r < -1 THEN 'stop_hit' WHEN r < -0.5 THEN 'reversal' WHEN r < 0 THEN 'slippage' END"


def mode() -> F.Column:
    return F.when(F.col("r") < -1.5, "gap").when(F.col("r") < -1, "stop_hit").when(F.col("r") < -0.5, "reversal").when(F.col("r") < 0, "slippage")


@query("e07_failure_counts", f"WITH {TRADES}, l AS (SELECT unnest({MODES}) AS mode), c AS (SELECT {MODE_SQL} AS mode, count(*) AS n FROM trades GROUP BY 1) SELECT l.mode, coalesce(n, 0) AS n, coalesce(n, 0) = max(coalesce(n, 0)) OVER () AS most FROM l LEFT JOIN c USING (mode)")
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every known label, zero for those that do not occur."""
    labels = spark.createDataFrame([(x,) for x in MODES], "mode string")
    counts = trades(spark, sf_dir).groupBy(mode().alias("mode")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return labels.join(counts, "mode", "left").select("mode", n.alias("n"), (n == F.max(n).over(W.partitionBy())).alias("most"))


@query("e08_veto_counts", f"WITH {TRADES} SELECT regime AS stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM trades WHERE r < 0 GROUP BY 1")
def veto_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trades(spark, sf_dir).where("r < 0").groupBy(F.col("regime").alias("stage")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query(
    "e09_false_negatives",
    f"WITH {TRADES}, v AS (SELECT regime AS stage, CASE WHEN r > 1 THEN 'TP2' WHEN r > 0 THEN 'TP1' WHEN r < -0.5 THEN 'STOP' END AS outcome FROM trades) SELECT coalesce(stage, 'ALL') AS stage, count(*) AS n, count(outcome) AS labeled, round(count(*) FILTER (outcome IN ('TP1', 'TP2')) / nullif(count(outcome), 0), 6) AS false_negative_rate FROM v GROUP BY ROLLUP (stage)",
)
def false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vetoed trades that would have reached a target, over those whose outcome is known, by stage and in all."""
    outcome = F.when(F.col("r") > 1, "TP2").when(F.col("r") > 0, "TP1").when(F.col("r") < -0.5, "STOP")
    v = trades(spark, sf_dir).select(F.col("regime").alias("stage"), outcome.alias("outcome"))
    g = v.rollup("stage").agg(F.count("*").alias("n"), F.count("outcome").alias("labeled"), F.count_if(F.col("outcome").isin("TP1", "TP2")).alias("hit"))
    return g.select(F.coalesce("stage", F.lit("ALL")).alias("stage"), "n", "labeled", F.round(m.safe(F.col("hit"), F.col("labeled")), 6).alias("false_negative_rate"))


@query(
    "e10_component_delta",
    f"WITH {TRADES}, u AS (SELECT pnl > 0 AS win, unnest(['quantity', 'notional', 'r']) AS component, unnest([quantity, notional, r]) AS v FROM trades) SELECT component, round(avg(v) FILTER (win) - avg(v) FILTER (NOT win), 6) AS delta, count(*) AS n FROM u GROUP BY 1",
)
def component_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    parts = F.create_map(*(x for c in ("quantity", "notional", "r") for x in (F.lit(c), F.col(c))))
    u = t.select((F.col("pnl") > 0).alias("win"), F.explode(parts).alias("component", "v"))
    return u.groupBy("component").agg(F.round(F.avg(F.when(F.col("win"), F.col("v"))) - F.avg(F.when(~F.col("win"), F.col("v"))), 6).alias("delta"), F.count("*").alias("n"))


@query("e11_autopsy", f"WITH {TRADES} SELECT strategy, {MODE_SQL} AS reason, count(*) AS n, round(sum(pnl), 4) AS total, round(avg(r), 6) AS mean_r, min(r) AS worst FROM trades WHERE r < 0 GROUP BY ALL")
def autopsy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).where("r < 0").groupBy("strategy", mode().alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("total"), F.round(F.avg("r"), 6).alias("mean_r"), F.min("r").alias("worst"))


RET = f"{TRADES}, d AS (SELECT system, {DAYS} AS day, sum(pnl) / 100000 AS ret FROM trades GROUP BY ALL)"


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).groupBy("system", F.date_trunc("day", "exit_ts").alias("day")).agg((F.sum("pnl") / 100_000).alias("ret"))


@query("e12_profit_factor", f"WITH {TRADES} SELECT system, round(least(coalesce(CASE WHEN sum(least(pnl, 0)) < 0 THEN sum(greatest(pnl, 0)) / -sum(least(pnl, 0)) END, CASE WHEN sum(greatest(pnl, 0)) > 0 THEN 20.0 ELSE 0 END), 20), 6) AS profit_factor FROM trades GROUP BY 1")
def profit_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).groupBy("system").agg(F.round(m.profit_factor("pnl", 20.0), 6).alias("profit_factor"))


@query("e13_win_rate", f"WITH {TRADES} SELECT system, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, count(*) FILTER (pnl > 0) AS wins, count(*) AS n FROM trades GROUP BY 1")
def win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).groupBy("system").agg(F.round(m.win_rate("pnl"), 6).alias("win_rate"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count("*").alias("n"))


@query("e14_sharpe", f"WITH {RET} SELECT system, round((avg(ret) - 0.02 / 252) / nullif(stddev_samp(ret), 0) * sqrt(252), 6) AS sharpe FROM d GROUP BY 1")
def sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_returns(spark, sf_dir).groupBy("system").agg(F.round(m.sharpe("ret"), 6).alias("sharpe"))


@query(
    "e15_sharpe_per_trade",
    f"""WITH {TRADES}, a AS (SELECT strategy, entry_ts, exit_ts, ln(1000000 + sum(pnl) OVER (PARTITION BY strategy ORDER BY {IN_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1000) AS le, order_id, line_no, notional, quantity, pnl FROM trades),
    b AS (SELECT *, le - coalesce(lag(le) OVER (PARTITION BY strategy ORDER BY {IN_ORDER_SQL}), 0) AS d FROM a)
    SELECT strategy, count(*) AS n, round(avg(d) / nullif(stddev_pop(d), 0) * sqrt(count(*) / (date_diff('day', min(entry_ts), max(exit_ts)) / 365.25)), 6) AS sharpe FROM b GROUP BY 1""",
)
def sharpe_per_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over steps of log equity; the first step is the first log equity itself."""
    t = blocks.running_sums(trades(spark, sf_dir).select("strategy", "entry_ts", *IN_ORDER), ["strategy"], IN_ORDER, {"total": F.col("pnl"), "no": F.lit(1)})
    equity = lambda total: F.log(1_000_000 + total / 1000)
    b = t.withColumn("d", equity(F.col("total")) - F.when(F.col("no") > 1, equity(F.col("total") - F.col("pnl"))).otherwise(0.0))
    years = F.datediff(F.max("exit_ts"), F.min("entry_ts")) / 365.25
    return b.groupBy("strategy").agg(F.count("*").alias("n"), F.round(m.safe(F.avg("d"), F.stddev_pop("d")) * F.sqrt(F.count("*") / years), 6).alias("sharpe"))


@query("e16_sharpe_unscaled", f"WITH {TRADES} SELECT regime, round(CASE WHEN count(r) >= 5 THEN coalesce(avg(r) / nullif(stddev_samp(r), 0), 0) ELSE 0 END, 6) AS sharpe FROM trades GROUP BY 1")
def sharpe_unscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).groupBy("regime").agg(F.round(m.sharpe_unscaled("r"), 6).alias("sharpe"))


@query("e17_sortino", f"WITH {RET} SELECT system, round((avg(ret) - 0.02 / 252) / nullif(stddev_samp(ret) FILTER (ret < 0), 0) * sqrt(252), 6) AS sortino FROM d GROUP BY 1")
def sortino(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_returns(spark, sf_dir).groupBy("system").agg(F.round(m.sortino("ret"), 6).alias("sortino"))


@query(
    "e18_calmar",
    f"""WITH {RET}, q AS (SELECT *, 1 + sum(ret) OVER (PARTITION BY system ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM d),
    p AS (SELECT *, greatest(max(equity) OVER (PARTITION BY system ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS peak FROM q)
    SELECT system, round(abs(avg(ret) * 252) / nullif(abs(min((equity - peak) / peak)), 0), 6) AS calmar, round(min((equity - peak) / peak * 100), 4) AS max_drawdown_pct FROM p GROUP BY 1""",
)
def calmar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_returns(spark, sf_dir)
    down = m.drawdown_by(d, "system", ["day"], "ret", 1.0, digits=12)
    yearly = d.groupBy("system").agg((F.avg("ret") * 252).alias("yearly"))
    return yearly.join(down, "system").select("system", F.round(m.safe(F.abs("yearly"), F.abs(F.col("max_drawdown_pct") / 100)), 6).alias("calmar"), F.round("max_drawdown_pct", 4).alias("max_drawdown_pct"))


@query(
    "e19_moments",
    f"WITH {TRADES}, a AS (SELECT regime, r, avg(r) OVER (PARTITION BY regime) AS m FROM trades) SELECT regime, round(avg((r - m) ** 3) / nullif(avg((r - m) ** 2) ** 1.5, 0), 5) AS skew, round(avg((r - m) ** 4) / nullif(avg((r - m) ** 2) ** 2, 0) - 3, 5) AS excess_kurtosis FROM a GROUP BY 1",
)
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).groupBy("regime").agg(F.round(F.skewness("r"), 5).alias("skew"), F.round(F.kurtosis("r"), 5).alias("excess_kurtosis"))


@query("e20_percentiles", f"WITH {TRADES} SELECT system, round(quantile_cont(r, 0.05), 6) AS p05, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.95), 6) AS p95 FROM trades GROUP BY 1")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact interpolated percentiles, by counts of ranges."""
    q = order_stats.quantiles(trades(spark, sf_dir), "r", ["system"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return q.select("system", *(F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")))


@query(
    "e21_interval",
    f"WITH {TRADES}, g AS (SELECT regime, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS p, count(*) AS n FROM trades GROUP BY 1) SELECT regime, round(p, 6) AS p, round(greatest(p - 1.96 * sqrt(p * (1 - p) / n), 0), 6) AS low, round(least(p + 1.96 * sqrt(p * (1 - p) / n), 1), 6) AS high FROM g",
)
def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trades(spark, sf_dir).groupBy("regime").agg(m.win_rate("pnl").alias("p"), F.count("*").alias("n"))
    low, high = m.binomial_interval(F.col("p"), F.col("n"))
    return g.select("regime", F.round("p", 6).alias("p"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


PROB = "(order_id * 37 + line_no * 11) % 100 / 100.0"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).withColumn("p", F.pmod(F.col("order_id") * 37 + F.col("line_no") * 11, F.lit(100)) / 100.0)


@query(
    "e22_calibration",
    f"WITH {TRADES}, b AS (SELECT least(floor({PROB} * 5), 4)::INT AS bucket, {PROB} AS p, pnl > 0 AS up FROM trades), g AS (SELECT bucket, count(*) AS n, count(*) FILTER (up) AS up, sum(p) AS expected FROM b GROUP BY 1) SELECT bucket, n, up, round(expected, 4) AS expected_up, round((up - expected) ** 2 / nullif(expected, 0) + (up - expected) ** 2 / nullif(n - expected, 0), 4) AS chi_squared FROM g",
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and expected wins in five equal buckets of the predicted chance, and their part of chi-squared."""
    b = predictions(spark, sf_dir).withColumn("bucket", F.least(F.floor(F.col("p") * 5), F.lit(4)).cast("int"))
    g = b.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("up"), F.sum("p").alias("e"))
    gap = (F.col("up") - F.col("e")) ** 2
    return g.select("bucket", "n", "up", F.round("e", 4).alias("expected_up"), F.round(gap / F.nullif(F.col("e"), F.lit(0.0)) + gap / F.nullif(F.col("n") - F.col("e"), F.lit(0.0)), 4).alias("chi_squared"))


@query(
    "e23_importance_drift",
    f"""WITH {TRADES}, b AS (SELECT regime AS feature, avg(abs(r)) AS base FROM trades WHERE year(exit_ts) < 1998 GROUP BY 1), c AS (SELECT regime AS feature, avg(abs(r)) AS cur FROM trades WHERE year(exit_ts) >= 1998 GROUP BY 1),
    j AS (SELECT feature, coalesce(base, 0) AS base, coalesce(cur, 0) AS cur FROM b FULL JOIN c USING (feature)), k AS (SELECT *, CASE WHEN base > 0 THEN abs(cur - base) / base END AS change FROM j)
    SELECT feature, round(base, 6) AS base, round(cur, 6) AS cur, round(change, 6) AS change, CASE WHEN base = 0 AND cur > 0.01 THEN 'NEW' WHEN change > 0.5 THEN 'HIGH' WHEN change > 0.001 THEN 'DRIFT' ELSE 'STABLE' END AS level FROM k""",
)
def importance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).select(F.col("regime").alias("feature"), F.abs("r").alias("x"), F.year("exit_ts").alias("y"))
    g = t.groupBy("feature").agg(F.coalesce(F.avg(F.when(F.col("y") < 1998, F.col("x"))), F.lit(0.0)).alias("base"), F.coalesce(F.avg(F.when(F.col("y") >= 1998, F.col("x"))), F.lit(0.0)).alias("cur"))
    g = g.withColumn("change", F.when(F.col("base") > 0, F.abs(F.col("cur") - F.col("base")) / F.nullif(F.col("base"), F.lit(0.0))))
    level = F.when((F.col("base") == 0) & (F.col("cur") > 0.01), "NEW").when(F.col("change") > 0.5, "HIGH").when(F.col("change") > 0.001, "DRIFT").otherwise("STABLE")
    return g.select("feature", *(F.round(c, 6).alias(c) for c in ("base", "cur", "change")), level.alias("level"))


@query(
    "e24_accuracy_drift",
    f"WITH {TRADES}, g AS (SELECT system, count(*) AS n, avg(CASE WHEN ({PROB} > 0.5) = (pnl > 0) THEN 1.0 ELSE 0 END) AS acc FROM trades GROUP BY 1) SELECT system, n, round(acc, 6) AS accuracy, n >= 10 AND 0.6 - acc > 0.05 AS drifted FROM g",
)
def accuracy_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = predictions(spark, sf_dir).groupBy("system").agg(F.count("*").alias("n"), F.avg(((F.col("p") > 0.5) == (F.col("pnl") > 0)).cast("double")).alias("acc"))
    return g.select("system", "n", F.round("acc", 6).alias("accuracy"), ((F.col("n") >= 10) & (0.6 - F.col("acc") > 0.05)).alias("drifted"))


RANKED = "(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


@query(
    "e25_rank_ic",
    f"WITH {TRADES}, k AS (SELECT regime, {RANKED.format(by='regime', x='quantity')} AS a, {RANKED.format(by='regime', x='r')} AS b FROM trades) SELECT regime, round(corr(a, b), 6) AS rank_corr, count(*) AS n FROM k GROUP BY 1",
)
def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.rank_correlation(trades(spark, sf_dir), "quantity", "r", ["regime"])


@query(
    "e26_ic_rankings",
    f"""WITH {BARS}, f AS (SELECT *, lead(close, 10) OVER (PARTITION BY symbol ORDER BY bar_no) / close - 1 AS fwd, close / lag(close, 10) OVER (PARTITION BY symbol ORDER BY bar_no) - 1 AS mom, CASE WHEN high > low THEN (close - low) / (high - low) END AS pos FROM bars),
    u AS (SELECT symbol, fwd, unnest(['momentum', 'place']) AS indicator, unnest([mom, pos]) AS v FROM f)
    SELECT symbol, indicator, round(corr(v, fwd), 6) AS ic, round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END) FILTER (v > 0.5), 6) AS hit_high, count(v) AS n FROM u WHERE fwd IS NOT NULL AND v IS NOT NULL GROUP BY ALL""",
)
def ic_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("symbol").orderBy("bar_no")
    f = bars(spark, sf_dir).withColumn("fwd", F.lead("close", 10).over(w) / F.col("close") - 1)
    f = f.withColumn("momentum", F.col("close") / F.lag("close", 10).over(w) - 1)
    f = f.withColumn("place", F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))))
    u = f.unpivot(["symbol", "fwd"], ["momentum", "place"], "indicator", "v").where("fwd is not null and v is not null")
    return u.groupBy("symbol", "indicator").agg(F.round(m.correlation("v", "fwd"), 6).alias("ic"), F.round(F.avg(F.when(F.col("v") > 0.5, (F.col("fwd") > 0).cast("double"))), 6).alias("hit_high"), F.count("v").alias("n"))


@query(
    "e27_ks",
    f"""WITH {TRADES}, s AS (SELECT regime, r, count(*) FILTER (system = 'O') AS a, count(*) FILTER (system <> 'O') AS b FROM trades GROUP BY ALL),
    c AS (SELECT regime, abs(sum(a) OVER w / nullif(sum(a) OVER p, 0) - sum(b) OVER w / nullif(sum(b) OVER p, 0)) AS gap FROM s WINDOW w AS (PARTITION BY regime ORDER BY r), p AS (PARTITION BY regime))
    SELECT regime, round(max(gap), 6) AS ks FROM c GROUP BY 1""",
)
def ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.ecdf_gap(trades(spark, sf_dir).withColumn("side", F.col("system") == "O"), "r", "side", ["regime"])


THRESHOLDS = [i / 10 for i in range(1, 10)]


@query(
    "e28_best_threshold",
    f"""WITH {TRADES}, q AS (SELECT unnest(quantile_cont(quantity, {THRESHOLDS})) AS t FROM trades), g AS (SELECT DISTINCT t FROM q),
    a AS (SELECT t, count(*) FILTER ((quantity > t) = (pnl > 0)) / count(*) AS gt, count(*) FILTER ((quantity < t) = (pnl > 0)) / count(*) AS lt FROM trades CROSS JOIN g GROUP BY 1),
    u AS (SELECT t, 'gt' AS side, gt AS acc FROM a UNION ALL SELECT t, 'lt', lt FROM a)
    SELECT round(acc, 6) AS accuracy, round(t, 6) AS threshold, side FROM u WHERE acc > 0.5 ORDER BY acc DESC, t, side LIMIT 1""",
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decile and side that tell wins from losses best, if better than half; one pass counts all of them."""
    t = trades(spark, sf_dir)
    names = {f"t{i}": x for i, x in enumerate(THRESHOLDS)}
    cuts = order_stats.quantiles(t, "quantity", [], names).select(F.array(*names).alias("q"))
    counted = t.join(F.broadcast(cuts)).groupBy("q").agg(
        F.count("*").alias("n"),
        *(F.count_if((F.col("quantity") > F.get("q", F.lit(i))) == (F.col("pnl") > 0)).alias(f"gt{i}") for i in range(9)),
        *(F.count_if((F.col("quantity") < F.get("q", F.lit(i))) == (F.col("pnl") > 0)).alias(f"lt{i}") for i in range(9)),
    )
    cases = F.array(*(F.struct((F.col(f"{s}{i}") / F.col("n")).alias("acc"), F.get("q", F.lit(i)).alias("t"), F.lit(s).alias("side")) for i in range(9) for s in ("gt", "lt")))
    best = counted.select(F.explode(cases).alias("c")).select("c.*").where("acc > 0.5").orderBy(F.desc("acc"), "t", "side").limit(1)
    return best.select(F.round("acc", 6).alias("accuracy"), F.round("t", 6).alias("threshold"), "side")


@query(
    "e29_gate_counterfactual",
    f"WITH {TRADES}, g AS (SELECT regime, avg(r) / nullif(stddev_samp(r), 0) * sqrt(25.2) AS base, avg(r) FILTER (quantity > 10) / nullif(stddev_samp(r) FILTER (quantity > 10), 0) * sqrt(25.2) AS kept, count(*) FILTER (quantity <= 10) AS vetoed FROM trades GROUP BY 1) SELECT regime, round(base, 5) AS base, round(kept, 5) AS kept, round(kept - base, 5) AS delta, vetoed FROM g",
)
def gate_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.when(F.col("quantity") > 10, F.col("r"))
    ratio = lambda x: m.safe(F.avg(x), F.stddev_samp(x)) * math.sqrt(252 / 10)
    g = trades(spark, sf_dir).groupBy("regime").agg(ratio(F.col("r")).alias("base"), ratio(keep).alias("kept"), F.count_if(F.col("quantity") <= 10).alias("vetoed"))
    return g.select("regime", F.round("base", 5).alias("base"), F.round("kept", 5).alias("kept"), F.round(F.col("kept") - F.col("base"), 5).alias("delta"), "vetoed")


@query("e30_breadth", f"WITH {BARS} SELECT ts, count(*) FILTER (close > open) AS advances, count(*) FILTER (close < open) AS declines, round(count(*) FILTER (close > open) / greatest(count(*) FILTER (close < open), 1), 6) AS ratio FROM bars GROUP BY 1")
def breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, down = F.count_if(F.col("close") > F.col("open")), F.count_if(F.col("close") < F.col("open"))
    return bars(spark, sf_dir).groupBy("ts").agg(up.alias("advances"), down.alias("declines"), F.round(up / F.greatest(down, F.lit(1)), 6).alias("ratio"))


@query(
    "e31_rotation",
    f"WITH {BARS}, g AS (SELECT symbol, arg_max(close, bar_no) / arg_min(close, bar_no) - 1 AS ret FROM bars GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY ret DESC, symbol) AS k, count(*) OVER () AS n FROM g) SELECT symbol, round(ret, 6) AS ret, CASE WHEN k <= n // 3 THEN 'leading' WHEN k > n - n // 3 THEN 'lagging' ELSE 'middle' END AS side FROM k",
)
def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols (one row each by then) ranked by their return; the first and last third."""
    g = bars(spark, sf_dir).groupBy("symbol").agg((F.max_by("close", "bar_no") / F.min_by("close", "bar_no") - 1).alias("ret"))
    g = g.withColumn("k", F.row_number().over(W.orderBy(F.desc("ret"), "symbol"))).withColumn("third", F.floor(F.count("*").over(W.partitionBy()) / 3)).withColumn("n", F.count("*").over(W.partitionBy()))
    return g.select("symbol", F.round("ret", 6).alias("ret"), F.when(F.col("k") <= F.col("third"), "leading").when(F.col("k") > F.col("n") - F.col("third"), "lagging").otherwise("middle").alias("side"))


SIDE_SQL = f"{TICKS}, s AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS dp FROM ticks), v AS (SELECT *, CASE WHEN dp > 0 THEN size WHEN dp < 0 THEN 0 ELSE size / 2 END AS buy, CASE WHEN dp < 0 THEN size WHEN dp > 0 THEN 0 ELSE size / 2 END AS sell FROM s)"


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = blocks.neighbour(ticks(spark, sf_dir), ["symbol"], ["ts", "event_id"], "price", "before").withColumn("dp", F.col("price") - F.col("before")).drop("before")
    up, down = F.col("dp") > 0, F.col("dp") < 0
    half = F.col("size") / 2
    return t.withColumn("buy", F.when(up, F.col("size")).when(down, 0.0).otherwise(half)).withColumn("sell", F.when(down, F.col("size")).when(up, 0.0).otherwise(half))


@query("e32_imbalance", f"WITH {SIDE_SQL} SELECT symbol, sum(buy) AS buy, sum(sell) AS sell, round(sum(buy) / greatest(sum(sell), 1), 6) AS ratio FROM v GROUP BY 1")
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed(spark, sf_dir).groupBy("symbol").agg(F.sum("buy").alias("buy"), F.sum("sell").alias("sell"), F.round(F.sum("buy") / F.greatest(F.sum("sell"), F.lit(1.0)), 6).alias("ratio"))


@query(
    "e33_price_impact",
    f"WITH {SIDE_SQL}, x AS (SELECT *, sign(dp) * size AS sv FROM v WHERE dp IS NOT NULL) SELECT symbol, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN covar_samp(dp, sv) / (var_pop(sv) + 1e-10) ELSE 0 END, 6) AS impact FROM x GROUP BY 1",
)
def price_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of price changes on signed volume (sample covariance over population variance)."""
    x = signed(spark, sf_dir).where("dp is not null").withColumn("sv", F.signum("dp") * F.col("size"))
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= 10, F.covar_samp("dp", "sv") / (F.var_pop("sv") + 1e-10)).otherwise(0.0), 6).alias("impact"))


@query(
    "e35_modes",
    f"""WITH {TRADES}, c AS (SELECT strategy, regime, count(*) AS n FROM trades GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY n DESC, regime) AS k FROM c),
    q AS (SELECT strategy, quantile_cont(quantity, 0.33) AS p33, quantile_cont(quantity, 0.66) AS p66 FROM trades GROUP BY 1)
    SELECT strategy, list(regime ORDER BY k) AS top3, round(any_value(p33), 6) AS p33, round(any_value(p66), 6) AS p66 FROM k JOIN q USING (strategy) WHERE k <= 3 GROUP BY 1""",
)
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    c = t.groupBy("strategy", "regime").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(W.partitionBy("strategy").orderBy(F.desc("n"), "regime")))
    top = c.where("k <= 3").groupBy("strategy").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "regime"))), lambda x: x["regime"]).alias("top3"))
    q = order_stats.quantiles(t, "quantity", ["strategy"], {"p33": 0.33, "p66": 0.66})
    return top.join(q.select("strategy", F.round("p33", 6).alias("p33"), F.round("p66", 6).alias("p66")), "strategy")


@query(
    "e36_transitions",
    f"WITH {TRADES}, s AS (SELECT regime AS s, strategy AS a, lead(regime) OVER (PARTITION BY system ORDER BY {IN_ORDER_SQL}) AS s2, r FROM trades) SELECT s, a, s2, count(*) AS n, round(sum(r), 4) AS reward FROM s WHERE s2 IS NOT NULL GROUP BY ALL",
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = staged(trades(spark, sf_dir).select("system", "regime", "strategy", "r", *IN_ORDER), "trades")  # ranges read their input twice
    t = blocks.neighbour(narrow, ["system"], IN_ORDER, "regime", "s2", ahead=True)
    s = t.select(F.col("regime").alias("s"), F.col("strategy").alias("a"), "s2", "r")
    return s.where("s2 is not null").groupBy("s", "a", "s2").agg(F.count("*").alias("n"), F.round(F.sum("r"), 4).alias("reward"))


@query("e37_weekly", summary_sql("date_trunc('week', exit_ts)::DATE AS week"))
def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.summary(trades(spark, sf_dir).withColumn("week", F.date_trunc("week", "exit_ts").cast("date")), ["week"])


@query(
    "e38_equity_summary",
    f"WITH {TRADES} SELECT count(*) AS n, round(sum(pnl), 4) AS total, round(avg(pnl) FILTER (pnl > 0), 6) AS mean_win, round(avg(pnl) FILTER (pnl <= 0), 6) AS mean_loss, round(100000 + sum(pnl), 4) AS final_equity, round(sum(greatest(pnl, 0)) / nullif(-sum(least(pnl, 0)), 0), 6) AS profit_factor FROM trades",
)
def equity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = F.col("pnl") > 0
    return trades(spark, sf_dir).agg(
        F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("total"), F.round(F.avg(F.when(win, F.col("pnl"))), 6).alias("mean_win"), F.round(F.avg(F.when(~win, F.col("pnl"))), 6).alias("mean_loss"),
        F.round(100_000 + F.sum("pnl"), 4).alias("final_equity"), F.round(m.profit_factor("pnl"), 6).alias("profit_factor"),
    )


WINDOWS = f"{TRADES}, w AS (SELECT strategy, year(exit_ts) AS y, avg(r) / nullif(stddev_samp(r), 0) AS sharpe, sum(pnl) AS total, count(*) AS n FROM trades GROUP BY ALL)"


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).groupBy("strategy", F.year("exit_ts").alias("y")).agg(m.safe(F.avg("r"), F.stddev_samp("r")).alias("sharpe"), F.sum("pnl").alias("total"), F.count("*").alias("n"))


@query(
    "e39_walk_forward",
    f"""WITH {WINDOWS}, g AS (SELECT strategy, avg(sharpe) AS mu, stddev_pop(sharpe) AS sd, min(sharpe) AS lo, max(sharpe) AS hi, sum(total) AS total, avg(CASE WHEN total > 0 THEN 1.0 ELSE 0 END) AS pos FROM w GROUP BY 1)
    SELECT strategy, round(mu, 6) AS mean, round(sd, 6) AS sd, round(lo, 6) AS low, round(hi, 6) AS high, round(total, 4) AS total, round(0.3 * greatest(0, 100 - 10 * sd) + 0.3 * 100 * (mu > 0)::INT + 0.4 * 100 * pos, 5) AS robustness FROM g""",
)
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = yearly(spark, sf_dir).groupBy("strategy").agg(
        F.avg("sharpe").alias("mu"), F.stddev_pop("sharpe").alias("sd"), F.min("sharpe").alias("lo"), F.max("sharpe").alias("hi"), F.sum("total").alias("sum"), F.avg((F.col("total") > 0).cast("double")).alias("pos")
    )
    score = 0.3 * F.greatest(F.lit(0.0), 100 - 10 * F.col("sd")) + 30 * (F.col("mu") > 0).cast("int") + 40 * F.col("pos")
    return g.select("strategy", F.round("mu", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("lo", 6).alias("low"), F.round("hi", 6).alias("high"), F.round("sum", 4).alias("total"), F.round(score, 5).alias("robustness"))


@query("e40_fold_sharpe", f"WITH {WINDOWS} SELECT strategy, round(sum(sqrt(n) * sharpe) / sum(sqrt(n)), 6) AS sharpe, round(sqrt((1 + (sum(sqrt(n) * sharpe) / sum(sqrt(n))) ** 2 / 2) / sum(n)), 6) AS se FROM w WHERE sharpe IS NOT NULL GROUP BY 1")
def fold_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.sum(F.sqrt("n") * F.col("sharpe")) / F.sum(F.sqrt("n"))
    g = yearly(spark, sf_dir).where("sharpe is not null").groupBy("strategy").agg(w.alias("s"), F.sum("n").alias("n"))
    return g.select("strategy", F.round("s", 6).alias("sharpe"), F.round(F.sqrt((1 + F.col("s") ** 2 / 2) / F.col("n")), 6).alias("se"))


@query(
    "e41_daily_range",
    f"WITH {BARS}, d AS (SELECT symbol, ts::DATE AS day, max(high) AS hi, min(low) AS lo FROM bars GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM d) SELECT symbol, round(avg(hi - lo), 6) AS mean_range, count(*) AS days FROM k WHERE k BETWEEN 2 AND 21 GROUP BY 1",
)
def daily_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean range of the twenty days before the last one."""
    d = bars(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    k = d.withColumn("k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("day"))))
    return k.where("k between 2 and 21").groupBy("symbol").agg(F.round(F.avg(F.col("hi") - F.col("lo")), 6).alias("mean_range"), F.count("*").alias("days"))


@query(
    "e42_outcomes",
    f"""WITH {TRADES}, o AS (SELECT system, CASE WHEN r > 0.5 THEN 'TP' WHEN r < -0.5 THEN 'STOP' ELSE 'FLAT' END AS cls, r, exit_ts FROM trades),
    g AS (SELECT system, count(*) AS n, count(*) FILTER (cls = 'TP') / count(*) AS tp, count(*) FILTER (cls = 'STOP') / count(*) AS st, count(*) FILTER (cls = 'FLAT') / count(*) AS fl, avg(r) FILTER (cls = 'TP') AS rt, avg(r) FILTER (cls = 'STOP') AS rs, avg(r) FILTER (cls = 'FLAT') AS rf, months_between_ AS months FROM (SELECT *, (date_diff('day', min(exit_ts) OVER (PARTITION BY system), max(exit_ts) OVER (PARTITION BY system)) / 30.0) AS months_between_ FROM o) GROUP BY ALL)
    SELECT system, round(tp, 6) AS p_target, round(st, 6) AS p_stop, round(fl, 6) AS p_flat, round(tp * coalesce(rt, 0) + st * coalesce(rs, 0) + fl * coalesce(rf, 0), 6) AS expected_r, round(n / months, 5) AS per_month FROM g""",
)
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.when(F.col("r") > 0.5, "TP").when(F.col("r") < -0.5, "STOP").otherwise("FLAT")
    o = trades(spark, sf_dir).withColumn("cls", cls)
    share = lambda c: F.count_if(F.col("cls") == c) / F.count("*")
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("cls") == c, F.col("r"))), F.lit(0.0))
    expected = share("TP") * mean("TP") + share("STOP") * mean("STOP") + share("FLAT") * mean("FLAT")
    per_month = F.count("*") / F.nullif(F.datediff(F.max("exit_ts"), F.min("exit_ts")) / 30.0, F.lit(0.0))
    return o.groupBy("system").agg(F.round(share("TP"), 6).alias("p_target"), F.round(share("STOP"), 6).alias("p_stop"), F.round(share("FLAT"), 6).alias("p_flat"), F.round(expected, 6).alias("expected_r"), F.round(per_month, 5).alias("per_month"))


@query("e43_trailing_count", f"WITH {TICKS} SELECT symbol, event_id, count(*) FILTER (price < 10) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM ticks")
def trailing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching events of the 24 hours up to each event: those until then, less those until before the hours began."""
    t = ticks(spark, sf_dir).select("symbol", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("price") < 10).cast("long").alias("hit"))
    ends = t.withColumn("sign", F.lit(1))
    starts = t.select("symbol", "event_id", (F.col("us") - 24 * 3600 * 1_000_000 - 1).alias("us"), F.lit(0).cast("long").alias("hit"), F.lit(-1).alias("sign"))
    swept = blocks.running_sums(ends.unionByName(starts), ["symbol"], ["us"], {"upto": F.col("hit")}, peers=True)
    return swept.groupBy("symbol", "event_id").agg(F.sum(F.col("sign") * F.col("upto")).alias("n"))


@query(
    "e44_base_rate",
    f"""WITH {BARS}, f AS (SELECT symbol, lead(close, 5) OVER (PARTITION BY symbol ORDER BY bar_no) / close - 1 AS fwd, close < lag(close) OVER (PARTITION BY symbol ORDER BY bar_no) * 0.9 AS setup FROM bars),
    g AS (SELECT symbol, count(*) AS n, avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END) AS p, avg(fwd) AS mean FROM f WHERE setup AND fwd IS NOT NULL GROUP BY 1 HAVING count(*) >= 15)
    SELECT symbol, n, round(p, 6) AS win_rate, round(mean, 6) AS mean, round(greatest(p - 1.96 * sqrt(p * (1 - p) / n), 0), 6) AS low, round(least(p + 1.96 * sqrt(p * (1 - p) / n), 1), 6) AS high FROM g""",
)
def base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("symbol").orderBy("bar_no")
    f = bars(spark, sf_dir).select("symbol", (F.lead("close", 5).over(w) / F.col("close") - 1).alias("fwd"), (F.col("close") < F.lag("close").over(w) * 0.9).alias("setup"))
    g = f.where("setup and fwd is not null").groupBy("symbol").agg(F.count("*").alias("n"), m.win_rate("fwd").alias("p"), F.avg("fwd").alias("mean")).where("n >= 15")
    low, high = m.binomial_interval(F.col("p"), F.col("n"))
    return g.select("symbol", "n", F.round("p", 6).alias("win_rate"), F.round("mean", 6).alias("mean"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "e45_lead_lag",
    f"""WITH {BARS}, x AS (SELECT ts, close / lag(close) OVER (ORDER BY ts) - 1 AS a FROM bars WHERE symbol = 'click'), y AS (SELECT ts, close / lag(close) OVER (ORDER BY ts) - 1 AS b FROM bars WHERE symbol = 'purchase'),
    j AS (SELECT ts, a, b, lag(a) OVER (ORDER BY ts) AS a1, lag(b) OVER (ORDER BY ts) AS b1 FROM x JOIN y USING (ts)), g AS (SELECT corr(a1, b) AS ab, corr(b1, a) AS ba, avg(a - b) AS spread, count(*) AS n FROM j)
    SELECT round(ab, 6) AS first_leads, round(ba, 6) AS second_leads, round(spread, 6) AS spread, n, CASE WHEN abs(ab) > abs(ba) THEN 'first' ELSE 'second' END AS leader FROM g""",
)
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two series moves first, by correlations of returns one bar apart (two symbols, so two series)."""
    w = W.partitionBy("symbol").orderBy("ts")
    r = bars(spark, sf_dir).where(F.col("symbol").isin("click", "purchase")).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    both = r.groupBy("ts").agg(F.count("*").alias("k"), *(F.max(F.when(F.col("symbol") == s, F.col("ret"))).alias(c) for s, c in (("click", "a"), ("purchase", "b")))).where("k = 2")
    j = both.withColumn("a1", F.lag("a").over(W.orderBy("ts"))).withColumn("b1", F.lag("b").over(W.orderBy("ts")))
    g = j.agg(m.correlation("a1", "b").alias("ab"), m.correlation("b1", "a").alias("ba"), F.avg(F.col("a") - F.col("b")).alias("spread"), F.count("*").alias("n"))
    return g.select(F.round("ab", 6).alias("first_leads"), F.round("ba", 6).alias("second_leads"), F.round("spread", 6).alias("spread"), "n", F.when(F.abs("ab") > F.abs("ba"), "first").otherwise("second").alias("leader"))


@query("e46_gamma_exposure", "SELECT l_returnflag AS expiry, round(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * l_discount * l_quantity * 100), 4) AS exposure FROM lineitem GROUP BY 1")
def gamma_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of gamma x open interest x multiplier over a chain; line items stand in for contracts."""
    sign = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    chain = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return chain.groupBy(F.col("l_returnflag").alias("expiry")).agg(F.round(F.sum(sign * F.col("l_discount") * F.col("l_quantity") * 100), 4).alias("exposure"))


RULES = [("gap", "cut size before events"), ("stop_hit", "widen the stop"), ("reversal", "take part profit early"), ("slippage", "use limit orders")]


@query("e47_rule_synthesis", f"WITH {TRADES}, c AS (SELECT strategy, {MODE_SQL} AS mode, count(*) AS n FROM trades WHERE r < 0 GROUP BY ALL HAVING count(*) >= 5), k(mode, rule) AS (VALUES {', '.join(map(str, RULES))}) SELECT strategy, mode, rule, n FROM c JOIN k USING (mode)")
def rule_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = trades(spark, sf_dir).where("r < 0").groupBy("strategy", mode().alias("mode")).agg(F.count("*").alias("n")).where("n >= 5")
    return c.join(F.broadcast(spark.createDataFrame(RULES, "mode string, rule string")), "mode").select("strategy", "mode", "rule", "n")


@query(
    "e48_decay",
    f"WITH {TRADES}, g AS (SELECT regime, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) FILTER (year(exit_ts) < 1998) AS base, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) FILTER (year(exit_ts) >= 1998) AS recent FROM trades GROUP BY 1) SELECT regime, round(base, 6) AS base, round(recent, 6) AS recent, CASE WHEN base IS NULL OR base = 0 OR recent IS NULL THEN 'UNKNOWN' WHEN (base - recent) / base >= 0.4 THEN 'DEAD' WHEN (base - recent) / base >= 0.25 THEN 'DECAYING' WHEN (base - recent) / base >= 0.15 THEN 'WEAKENING' ELSE 'HEALTHY' END AS level FROM g",
)
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    win, y = (F.col("pnl") > 0).cast("double"), F.year("exit_ts")
    g = trades(spark, sf_dir).groupBy("regime").agg(F.avg(F.when(y < 1998, win)).alias("base"), F.avg(F.when(y >= 1998, win)).alias("recent"))
    drop = (F.col("base") - F.col("recent")) / F.nullif(F.col("base"), F.lit(0.0))
    level = F.when(drop.isNull(), "UNKNOWN").when(drop >= 0.4, "DEAD").when(drop >= 0.25, "DECAYING").when(drop >= 0.15, "WEAKENING").otherwise("HEALTHY")
    return g.select("regime", F.round("base", 6).alias("base"), F.round("recent", 6).alias("recent"), level.alias("level"))


@query(
    "e49_veto_health",
    f"WITH {TRADES}, g AS (SELECT regime AS stage, count(*) AS n FROM trades WHERE r < 0 GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS share FROM g) SELECT stage, round(share, 6) AS share, share > 0.2 AS violation, round(greatest(0, 100 - 20 * sum((share > 0.2)::INT) OVER ()), 4) AS health FROM s",
)
def veto_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = W.partitionBy()
    s = trades(spark, sf_dir).where("r < 0").groupBy(F.col("regime").alias("stage")).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(everything))
    bad = F.col("share") > 0.2
    return s.select("stage", F.round("share", 6).alias("share"), bad.alias("violation"), F.greatest(F.lit(0.0), 100.0 - 20 * F.sum(bad.cast("int")).over(everything)).alias("health"))


@query(
    "e50_regime_stats",
    f"WITH {TRADES} SELECT regime, count(*) AS n, round(sum(pnl), 4) AS total, round(avg(r), 6) AS mean_r, count(*) FILTER (r < -1) AS vetoed, min(exit_ts) AS first_exit, max(exit_ts) AS last_exit FROM trades GROUP BY 1",
)
def regime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).groupBy("regime").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("total"), F.round(F.avg("r"), 6).alias("mean_r"), F.count_if(F.col("r") < -1).alias("vetoed"), F.min("exit_ts").alias("first_exit"), F.max("exit_ts").alias("last_exit"))


WORDS = r"[^\x20\x09-\x0D]+"
TICKERS = "error cache index table model".split()
GOOD, BAD = "great good strong win".split(), "bad weak loss fail".split()


@query(
    "e34_mentions",
    rf"""WITH w AS (SELECT doc_id, n_chars, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM documents WHERE text IS NOT NULL),
    m AS (SELECT doc_id, n_chars, ws, unnest(list_intersect(ws, {TICKERS})) AS ticker FROM w),
    s AS (SELECT ticker, doc_id, n_chars, len(list_intersect(ws, {GOOD})) - len(list_intersect(ws, {BAD})) AS mood FROM m),
    k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n_chars DESC, doc_id) AS k FROM s)
    SELECT ticker, count(*) AS n, sum(mood)::BIGINT AS mood, list(doc_id ORDER BY k) FILTER (k <= 3) AS top FROM k GROUP BY 1""",
)
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that name a ticker: how many, their net mood, and the three longest; a post counts once for each ticker."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    ws = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))
    hits = lambda words: F.size(F.array_intersect("ws", F.array(*map(F.lit, words))))
    m_ = d.select("doc_id", "n_chars", ws.alias("ws")).select("doc_id", "n_chars", (hits(GOOD) - hits(BAD)).alias("mood"), F.explode(F.array_intersect("ws", F.array(*map(F.lit, TICKERS)))).alias("ticker"))
    total = m_.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("mood").alias("mood"))
    top = m_.withColumn("k", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("n_chars"), "doc_id"))).where("k <= 3")
    best = top.groupBy("ticker").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "doc_id"))), lambda x: x["doc_id"]).alias("top"))
    return total.join(best, "ticker")

"""Performance measures as aggregate columns, and the analytics built on them.

Everything is a partial aggregation before its shuffle; measures that need an order take it from a window by system.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators import blocks
from tapewright.sources.staging import staged


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe(a: Column, b: Column, other: float | None = None) -> Column:
    out = a / F.nullif(b.cast("double"), F.lit(0.0))
    return out if other is None else F.coalesce(out, F.lit(other))


def win_rate(x: str | Column) -> Column:
    return F.avg((_c(x) > 0).cast("double"))


def profit_factor(x: str | Column, cap: float | None = None) -> Column:
    """Gains over losses; without losses the cap, or null."""
    gain, loss = F.sum(F.greatest(_c(x), F.lit(0.0))), -F.sum(F.least(_c(x), F.lit(0.0)))
    out = F.when(loss > 0, gain / F.nullif(loss, F.lit(0.0)))
    return out if cap is None else F.least(F.coalesce(out, F.when(gain > 0, F.lit(cap)).otherwise(0.0)), F.lit(cap))


def sharpe(x: str | Column, periods: float = 252, risk_free: float = 0.02) -> Column:
    return safe(F.avg(_c(x)) - risk_free / periods, F.stddev_samp(_c(x))) * math.sqrt(periods)


def sharpe_unscaled(x: str | Column, least: int = 5) -> Column:
    return F.when(F.count(_c(x)) >= least, safe(F.avg(_c(x)), F.stddev_samp(_c(x)), 0.0)).otherwise(0.0)


def sortino(x: str | Column, periods: float = 252, risk_free: float = 0.02) -> Column:
    return safe(F.avg(_c(x)) - risk_free / periods, F.stddev_samp(F.when(_c(x) < 0, _c(x)))) * math.sqrt(periods)


def binomial_interval(p: Column, n: Column) -> tuple[Column, Column]:
    half = 1.96 * F.sqrt(p * (1 - p) / n)
    return F.greatest(p - half, F.lit(0.0)), F.least(p + half, F.lit(1.0))


def summary(df: DataFrame, keys: Sequence[str], pnl: str = "pnl") -> DataFrame:
    """Count, wins, win rate, total, mean and profit factor by ``keys``."""
    return df.where(F.col(pnl).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(pnl) > 0).alias("wins"),
        F.round(win_rate(pnl), 6).alias("win_rate"),
        F.round(F.sum(pnl), 4).alias("total"),
        F.round(F.avg(pnl), 6).alias("mean"),
        F.round(profit_factor(pnl), 6).alias("profit_factor"),
    )


def cells(df: DataFrame, dims: Sequence[str], x: str = "r", least: int = 10) -> DataFrame:
    """Every combination of present and omitted dimensions, omitted ones as 'ALL'."""
    out = df.cube(*dims).agg(F.count("*").alias("n"), F.round(win_rate(x), 6).alias("win_rate"), F.round(sharpe_unscaled(x), 6).alias("sharpe"))
    return out.select(*(F.coalesce(d, F.lit("ALL")).alias(d) for d in dims), "n", "win_rate", "sharpe", (F.col("n") >= least).alias("reliable"))


def bucketed(x: Column, edges: Sequence[float]) -> Column:
    """The number of the right-closed bucket between ``edges`` that holds ``x``; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), i).otherwise(out)
    return out


def drawdown_by(df: DataFrame, key: str, order: Sequence[str], pnl: str, capital: float, digits: int = 4) -> DataFrame:
    """Deepest fall from the running peak of equity, in percent, by ``key``."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    eq = df.withColumn("equity", capital + F.sum(pnl).over(w)).withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(capital)))
    return eq.groupBy(key).agg(F.round(F.min((F.col("equity") - F.col("peak")) / F.col("peak") * 100), digits).alias("max_drawdown_pct"))


def corr(x: str | Column, y: str | Column) -> tuple[Column, Column, Column]:
    """Correlation as (covariance, deviation, deviation), so that a side that does not vary gives null, not an error."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    x, y = F.when(both, _c(x)), F.when(both, _c(y))
    return F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)


def correlation(x: str | Column, y: str | Column, over: WindowSpec | None = None) -> Column:
    cov, a, b = (c if over is None else c.over(over) for c in corr(x, y))
    return F.when((a > 1e-12) & (b > 1e-12), cov / F.nullif(a * b, F.lit(0.0)))


def rank_correlation(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Correlation of the ranks (ties at their mean) of ``x`` and ``y`` among rows that have both.

    Rows are counted by pair of values first, and ranks are running counts over values, so that a group may be any size.
    """
    pairs = staged(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("_n")), "pairs")
    ranked = pairs
    for c, out in ((x, "_x"), (y, "_y")):
        counts = pairs.groupBy(*by, c).agg(F.sum("_n").alias("_m"))
        ranks = blocks.running_sums(counts, by, [c], {"_upto": F.col("_m")}).select(*by, c, (F.col("_upto") - (F.col("_m") - 1) / 2).alias(out))
        ranked = ranked.join(ranks, [*by, c])
    middle = ranked.groupBy(*by).agg(((F.sum("_n") + 1) / 2).alias("_mid"))  # the mean of ranks with ties is that without
    d = ranked.join(middle, [*by]).select(*by, "_n", (F.col("_x") - F.col("_mid")).alias("a"), (F.col("_y") - F.col("_mid")).alias("b"))
    total = lambda e: F.sum(F.col("_n") * e)
    g = d.groupBy(*by).agg(total(F.col("a") * F.col("b")).alias("ab"), total(F.col("a") ** 2).alias("aa"), total(F.col("b") ** 2).alias("bb"), F.sum("_n").alias("n"))
    return g.select(*by, F.round(F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))), 6).alias("rank_corr"), "n")


def ecdf_gap(df: DataFrame, x: str, side: str, by: Sequence[str]) -> DataFrame:
    """Two-sample distance: the largest gap between the distributions of rows with and without ``side``."""
    steps = df.groupBy(*by, x).agg(F.sum(F.col(side).cast("int")).alias("a"), F.sum((~F.col(side)).cast("int")).alias("b"))
    run, whole = W.partitionBy(*by).orderBy(x), W.partitionBy(*by)
    gap = F.abs(F.sum("a").over(run) / F.nullif(F.sum("a").over(whole).cast("double"), F.lit(0.0)) - F.sum("b").over(run) / F.nullif(F.sum("b").over(whole).cast("double"), F.lit(0.0)))
    return steps.withColumn("gap", gap).groupBy(*by).agg(F.round(F.max("gap"), 6).alias("ks"))


def auc_strict(df: DataFrame, score: str, positive: str, by: Sequence[str]) -> DataFrame:
    """Chance that a positive row scores above a negative one; ties count as nothing. Score values are counted first."""
    steps = df.groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("q"))
    below = F.coalesce(F.sum("q").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = steps.withColumn("u", F.col("p") * below).groupBy(*by).agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return out.select(*by, F.round(F.col("u") / F.nullif((F.col("p") * F.col("q")).cast("double"), F.lit(0.0)), 6).alias("auc"))


def adjusted_p(df: DataFrame, p: str, alpha: float = 0.1) -> DataFrame:
    """Step-up adjusted p-values and whether they pass; a list of hypotheses is small by nature."""
    up, everything = W.orderBy(F.col(p), "hypothesis"), W.partitionBy()
    df = df.withColumn("rank", F.row_number().over(up)).withColumn("m", F.count("*").over(everything))
    raw = F.col(p) * F.col("m") / F.col("rank")
    back = W.orderBy(F.col("rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("adjusted", F.least(F.min(raw).over(back), F.lit(1.0)))
    return df.select("hypothesis", F.round(p, 6).alias("p"), F.round("adjusted", 6).alias("adjusted"), (F.col("adjusted") <= alpha).alias("passes"))

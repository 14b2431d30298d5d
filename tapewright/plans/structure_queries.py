"""Market structure, indicator panels, composite features and plug-ins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions import indicators as ind
from tapewright.functions.columns import C, H, L, O, V
from tapewright.functions.frames import BY, ahead, last, mean, prev, ratio, std, true_range
from tapewright.functions.scans import scan
from tapewright.operators import metrics as m
from tapewright.operators import blocks, plugins
from tapewright.plans import indicator_queries as iq
from tapewright.plans.join_queries import MACRO_AT, with_macro
from tapewright.plans.registry import Registry
from tapewright.plans.simulation_queries import bracket_sql
from tapewright.plans.sql import BARS, TRADES, full, lag, w
from tapewright.sources.market import IN_ORDER, bars, trades
from tapewright.sources.staging import staged

query = Registry()
QUERIES, SQL = query.queries, query.sql
ORDER_SQL = ", ".join(IN_ORDER)
OVER = "OVER (PARTITION BY symbol ORDER BY bar_no)"
ATR = f"{BARS}, t0 AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars), a AS (SELECT *, {full('avg', 'tr', 14)} AS atr FROM t0)"


def ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("tr", true_range()).withColumn("atr", mean("tr", 14))


@query(
    "f07_atr_seeded",
    f"WITH RECURSIVE {BARS}, t AS (SELECT symbol, bar_no, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars), s AS (SELECT symbol, avg(tr) AS seed FROM t WHERE bar_no <= 14 GROUP BY 1), r AS (SELECT t.symbol, bar_no, seed AS x FROM t JOIN s USING (symbol) WHERE bar_no = 14 UNION ALL SELECT t.symbol, t.bar_no, (r.x * 13 + t.tr) / 14 FROM r JOIN t ON t.symbol = r.symbol AND t.bar_no = r.bar_no + 1) SELECT symbol, bar_no, round(x, 5) AS atr FROM r UNION ALL SELECT symbol, bar_no, round(seed, 5) FROM t JOIN s USING (symbol) WHERE bar_no < 14",
)
def atr_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilder's mean from the mean of the first 14 ranges, which stands for those bars too."""

    def kernel(a):
        x = a["tr"]
        out = np.full(len(x), x[:14].mean() if len(x) else np.nan)
        for i in range(14, len(x)):
            out[i] = (out[i - 1] * 13 + x[i]) / 14
        return {"atr": out}

    out = scan(bars(spark, sf_dir).withColumn("tr", true_range()), kernel, ["atr"], ["tr"])
    return out.select("symbol", "bar_no", F.round("atr", 5).alias("atr"))


CHANGES = "list_transform(range(1, len(xs)), lambda i: xs[i + 1] - xs[i])"
SEEDED = "list_reduce(list_prepend(list_sum(list_transform(d[1:14], lambda x: greatest({sign}x, 0))) / 14, list_transform(d[15:], lambda x: greatest({sign}x, 0))), lambda s, x: (s * 13 + x) / 14)"


@query(
    "f11_rsi_seeded",
    f"WITH {BARS}, x AS (SELECT symbol, bar_no, list(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS xs FROM bars), d AS (SELECT symbol, bar_no, {CHANGES} AS d FROM x WHERE len(xs) >= 16), g AS (SELECT symbol, bar_no, {SEEDED.format(sign='')} AS g, {SEEDED.format(sign='-')} AS l FROM d) SELECT symbol, bar_no, round(100 - 100 / (1 + g / nullif(l, 0)), 6) AS rsi FROM g",
)
def rsi_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilder's index over the ninety bars before each bar, from the mean of the first 14 changes."""
    b = bars(spark, sf_dir).withColumn("xs", F.collect_list("close").over(BY().rowsBetween(-90, -1))).where(F.size("xs") >= 16)
    d = F.transform(F.slice("xs", 2, 90), lambda x, i: x - F.get(F.col("xs"), i))
    b = b.withColumn("d", d)
    seed = lambda sign: F.aggregate(F.slice("d", 1, 14), F.lit(0.0), lambda s, x: s + F.greatest(x * sign, F.lit(0.0))) / 14
    start = F.struct(seed(1).alias("g"), seed(-1).alias("l"))
    step = lambda s, x: F.struct(((s["g"] * 13 + F.greatest(x, F.lit(0.0))) / 14).alias("g"), ((s["l"] * 13 + F.greatest(-x, F.lit(0.0))) / 14).alias("l"))
    rsi = F.aggregate(F.slice("d", 15, 90), start, step, lambda s: 100 - 100 / (1 + s["g"] / F.nullif(s["l"], F.lit(0.0))))
    return b.select("symbol", "bar_no", F.round(rsi, 6).alias("rsi"))


@query("f14_directional_single", f"WITH {ATR}, d AS (SELECT symbol, bar_no, {full('avg', 'greatest(high - hb, 0)', 14)} AS p, {full('avg', 'greatest(lb - low, 0)', 14)} AS n FROM (SELECT *, {lag('high')} AS hb, {lag('low')} AS lb FROM bars)) SELECT symbol, bar_no, round(100 * abs(p - n) / nullif(p + n, 0), 6) AS dx FROM d")
def directional_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("p0", F.greatest(H() - prev("high"), F.lit(0.0))).withColumn("n0", F.greatest(prev("low") - L(), F.lit(0.0)))
    p, n = mean("p0", 14), mean("n0", 14)
    return b.select("symbol", "bar_no", F.round(100 * ratio(F.abs(p - n), p + n), 6).alias("dx"))


RUN = 10_000  # trades in one window
PANEL = ["f02_sma", "f08_rsi", "f23_stochastic", "f25_williams", "f26_roc", "f28_bollinger", "f31_donchian", "f37_cmf", "f38_gap_state", "f39_break_of_structure", "f42_sweep_state", "f64_range_position"]
PANEL_SQL = "panel AS (" + " UNION ALL ".join(f"SELECT '{n}' AS indicator, symbol, bar_no, state FROM ({iq.SQL[n]})" for n in PANEL) + ")"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with a column of states for each indicator of the panel."""
    return ind.with_states(bars(spark, sf_dir), {n: iq.FUNCTIONS[n] for n in PANEL})


def how_many(states: str) -> F.Column:
    return sum((F.expr(f"{n} {states}").cast("long") for n in PANEL), F.lit(0).cast("long"))


@query("f44_panel", f"WITH {PANEL_SQL} SELECT indicator, count(*) AS n, count(*) FILTER (state > 0) AS up, count(*) FILTER (state < 0) AS down FROM panel GROUP BY 1")
def panel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.struct(F.count("*").alias("n"), F.count_if(F.col(c) > 0).alias("up"), F.count_if(F.col(c) < 0).alias("down")).alias(c) for c in PANEL]
    rows = panel(spark, sf_dir).agg(*counts)
    return rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("indicator"), f"{c}.n", f"{c}.up", f"{c}.down") for c in PANEL))))


@query(
    "f45_consensus",
    f"WITH {PANEL_SQL}, g AS (SELECT symbol, bar_no, count(*) FILTER (state > 0) AS up, count(*) FILTER (state < 0) AS down, count(*) AS n FROM panel GROUP BY ALL), s AS (SELECT *, (up - down) / n AS s FROM g) SELECT symbol, bar_no, up, down, CASE WHEN up >= 8 THEN 1 WHEN down >= 8 THEN -1 WHEN abs(s) <= 0.05 THEN 0 WHEN s > 0.15 THEN 1 WHEN s < -0.15 THEN -1 ELSE 0 END AS direction, round(least(2.5 * abs(s), 1), 6) AS conviction FROM s",
)
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = panel(spark, sf_dir).select("symbol", "bar_no", how_many("> 0").alias("up"), how_many("< 0").alias("down"))
    s = (F.col("up") - F.col("down")) / len(PANEL)
    side = F.when(F.col("up") >= 8, 1).when(F.col("down") >= 8, -1).when(F.abs(s) <= 0.05, 0).when(s > 0.15, 1).when(s < -0.15, -1).otherwise(0)
    return g.select("symbol", "bar_no", "up", "down", side.alias("direction"), F.round(F.least(2.5 * F.abs(s), F.lit(1.0)), 6).alias("conviction"))


FWD = f"{BARS}, fwd AS (SELECT symbol, bar_no, lead(close, 5) {OVER} / close - 1 AS y, bar_no * 10 <= max(bar_no) OVER (PARTITION BY symbol) * 6 AS early FROM bars)"


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, c, side, early, n, hits) for every three indicators that agree, by the part of the series.

    ``early`` are the first three fifths of a symbol's bars. Bars of the same signs are counted together first, so that threes are made
    of the patterns that occur and not of every bar.
    """
    early = F.col("bar_no") * 10 <= F.max("bar_no").over(W.partitionBy("symbol")) * 6
    p = panel(spark, sf_dir).withColumn("y", ahead("close", 5) / C() - 1).withColumn("early", early).where("y is not null")
    signs = F.array(*(F.coalesce(F.signum(n), F.lit(0.0)).cast("int") for n in sorted(PANEL)))
    kinds = p.groupBy(signs.alias("signs"), "early").agg(F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("up"), F.count_if(F.col("y") < 0).alias("down"))
    names = F.array(*map(F.lit, sorted(PANEL)))
    agreed = lambda side: F.filter(F.zip_with(names, "signs", lambda n, s: F.when(s == side, n)), lambda n: n.isNotNull())
    sides = F.array(*(F.struct(F.lit(k).alias("side"), agreed(k).alias("s"), F.col(hits).alias("hits")) for k, hits in ((1, "up"), (-1, "down"))))
    of = kinds.select("early", "n", F.explode(sides).alias("of")).select("early", "n", "of.*")
    n = F.size("s")
    three = F.flatten(F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, n), lambda b, j: F.transform(F.slice(F.col("s"), i + j + 3, n), lambda c: F.struct(a.alias("a"), b.alias("b"), c.alias("c")))))))
    return of.where(n >= 3).select("side", "early", "n", "hits", F.explode(three).alias("t")).select("t.*", "side", "early", "n", "hits")


TRIPLES = f"{PANEL_SQL}, {FWD}, st AS (SELECT *, sign(state)::INT AS side FROM panel WHERE state <> 0), tr AS (SELECT x.indicator AS a, y.indicator AS b, z.indicator AS c, x.side, f.early, f.y FROM st x JOIN st y ON x.symbol = y.symbol AND x.bar_no = y.bar_no AND x.side = y.side AND x.indicator < y.indicator JOIN st z ON x.symbol = z.symbol AND x.bar_no = z.bar_no AND x.side = z.side AND y.indicator < z.indicator JOIN fwd f ON f.symbol = x.symbol AND f.bar_no = x.bar_no WHERE f.y IS NOT NULL)"


@query("f46_triples", f"WITH {TRIPLES} SELECT a, b, c, side, count(*) AS n, round(avg((y * side > 0)::INT), 6) AS hit FROM tr GROUP BY ALL HAVING count(*) >= 30 AND avg((y * side > 0)::INT) >= 0.55")
def green_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).groupBy("a", "b", "c", "side").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("h")).where("n >= 30 and h >= 0.55").select("a", "b", "c", "side", "n", F.round("h", 6).alias("hit"))


@query(
    "f47_holdout",
    f"WITH {TRIPLES}, g AS (SELECT a, b, c, side, count(*) FILTER (early) AS n1, count(*) FILTER (NOT early) AS n2, avg((y * side > 0)::INT) FILTER (early) AS h1, avg((y * side > 0)::INT) FILTER (NOT early) AS h2 FROM tr GROUP BY ALL) SELECT a, b, c, side, CASE WHEN n2 < 10 THEN 'INSUFFICIENT' WHEN h1 - h2 < 0.1 THEN 'REAL' WHEN h1 - h2 <= 0.2 THEN 'WEAK' ELSE 'OVERFIT' END AS verdict FROM g WHERE n1 >= 20 AND h1 >= 0.5",
)
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations found on the first bars, judged on the later ones."""
    total = lambda c, part: F.coalesce(F.sum(F.when(part, F.col(c))), F.lit(0).cast("long"))
    early = F.col("early")
    g = triples(spark, sf_dir).groupBy("a", "b", "c", "side").agg(total("n", early).alias("n1"), total("n", ~early).alias("n2"), total("hits", early).alias("k1"), total("hits", ~early).alias("k2"))
    g = g.withColumn("h1", F.col("k1") / F.nullif(F.col("n1"), F.lit(0))).withColumn("h2", F.col("k2") / F.nullif(F.col("n2"), F.lit(0)))
    gap = F.col("h1") - F.col("h2")
    verdict = F.when(F.col("n2") < 10, "INSUFFICIENT").when(gap < 0.1, "REAL").when(gap <= 0.2, "WEAK").otherwise("OVERFIT")
    return g.where("n1 >= 20 and h1 >= 0.5").select("a", "b", "c", "side", verdict.alias("verdict"))


@query(
    "f54_slowing_down",
    f"WITH {BARS}, d AS (SELECT symbol, bar_no, close - avg(close) {w(20)} AS x FROM bars), g AS (SELECT symbol, bar_no, var_samp(x) {w(20)} AS v, CASE WHEN bar_no >= 40 THEN corr(x, x1) {w(20)} END AS ar1 FROM (SELECT *, {lag('x')} AS x1 FROM d)) SELECT symbol, bar_no, round(CASE WHEN bar_no >= 40 THEN v - lag(v, 5) {OVER} END, 4) AS velocity, round(ar1, 5) AS ar1, round(CASE WHEN ar1 > 0 AND ar1 < 1 THEN -ln(ar1) END, 5) AS recovery FROM g",
)
def slowing_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of variance around the mean, memory from bar to bar, and how fast shocks fade."""
    d = bars(spark, sf_dir).withColumn("x", C() - F.avg("close").over(last(20))).withColumn("x1", prev("x"))
    d = d.withColumn("v", F.var_samp("x").over(last(20))).withColumn("ar1", F.when(F.col("bar_no") >= 40, m.correlation("x", "x1", last(20))))
    a = F.col("ar1")
    fade = F.when((a > 0) & (a < 1), -F.log(F.when(a > 0, a)))
    return d.select("symbol", "bar_no", F.round(F.when(F.col("bar_no") >= 40, F.col("v") - prev("v", 5)), 4).alias("velocity"), F.round(a, 5).alias("ar1"), F.round(fade, 5).alias("recovery"))


@query(
    "f63_structure_score",
    f"WITH {iq.SQL['f62_swing_points'].removeprefix('WITH ').rsplit('SELECT symbol, bar_no, round(raw', 1)[0].rstrip()}, h AS (SELECT symbol, bar_no, state, b.high, b.low FROM (SELECT symbol, bar_no, CASE WHEN n < 7 THEN 0 WHEN high = hi THEN 1 WHEN low = lo THEN -1 ELSE 0 END AS state FROM fin) s JOIN bars b USING (symbol, bar_no) WHERE state <> 0), k AS (SELECT *, CASE WHEN state = 1 THEN high ELSE low END AS p, lag(CASE WHEN state = 1 THEN high ELSE low END) OVER (PARTITION BY symbol, state ORDER BY bar_no) AS q FROM h) SELECT symbol, bar_no, state, CASE WHEN q IS NULL THEN 'NONE' WHEN state = 1 THEN CASE WHEN p > q THEN 'HH' ELSE 'LH' END ELSE CASE WHEN p > q THEN 'HL' ELSE 'LL' END END AS kind FROM k",
)
def structure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each swing against the one before of its kind."""
    b = bars(spark, sf_dir)
    s = ind.swing_points(b).where("state <> 0").select("symbol", "bar_no", "state").join(b.select("symbol", "bar_no", "high", "low"), ["symbol", "bar_no"])
    s = s.withColumn("p", F.when(F.col("state") == 1, H()).otherwise(L())).withColumn("q", F.lag("p").over(W.partitionBy("symbol", "state").orderBy("bar_no")))
    up = F.col("p") > F.col("q")
    kind = F.when(F.col("q").isNull(), "NONE").when(F.col("state") == 1, F.when(up, "HH").otherwise("LH")).otherwise(F.when(up, "HL").otherwise("LL"))
    return s.select("symbol", "bar_no", "state", kind.alias("kind"))


@query("f65_displacement_score", f"WITH {ATR}, r AS (SELECT *, avg(high - low) {w(20)} AS ar FROM a), s AS (SELECT symbol, bar_no, CASE WHEN abs(close - open) >= 0.55 * atr AND high - low >= 1.3 * ar THEN least(0.6 + 0.4 * (abs(close - open) / atr - 0.55), 1) ELSE 0 END AS x FROM r) SELECT symbol, bar_no, round(max(x) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 6) AS score FROM s")
def displacement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest move of the next five bars, by body and range."""
    body, a = F.abs(C() - O()), F.col("atr")
    b = ranged(spark, sf_dir).withColumn("ar", F.avg(H() - L()).over(last(20)))
    x = F.when((body >= 0.55 * a) & (H() - L() >= 1.3 * F.col("ar")), F.least(0.6 + 0.4 * (body / a - 0.55), F.lit(1.0))).otherwise(0.0)
    return b.withColumn("x", x).select("symbol", "bar_no", F.round(F.max("x").over(BY().rowsBetween(1, 5)), 6).alias("score"))


@query("f69_nearest_gap", f"WITH {BARS}, g AS (SELECT symbol, bar_no, low AS top, {lag('high', 2)} AS bottom, high AS h, {lag('low', 2)} AS l2 FROM bars), n AS (SELECT symbol, arg_max(close, bar_no) AS now FROM bars GROUP BY 1) SELECT symbol, max(top) FILTER (top > bottom AND top < now) AS below, min(h) FILTER (h < l2 AND h > now) AS above FROM g JOIN n USING (symbol) GROUP BY 1")
def nearest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest three-bar gap below the last price, by its top, and above it, by its bottom."""
    whole = W.partitionBy("symbol")
    g = bars(spark, sf_dir).withColumn("bottom", prev("high", 2)).withColumn("l2", prev("low", 2)).withColumn("now", F.max_by("close", "bar_no").over(whole))
    below = F.when((L() > F.col("bottom")) & (L() < F.col("now")), L())
    above = F.when((H() < F.col("l2")) & (H() > F.col("now")), H())
    return g.groupBy("symbol").agg(F.max(below).alias("below"), F.min(above).alias("above"))


@query("f70_level_clusters")
def level_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swing highs gathered around seeds in time order within a tolerance; two touches make a level."""
    import pandas as pd

    swings = ind.swing_points(bars(spark, sf_dir)).where("state = 1").select("symbol", "bar_no", F.col("raw").alias("price"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        seeds: list[list[float]] = []
        for price in frame.sort_values("bar_no")["price"]:
            near = next((s for s in seeds if abs(price - s[0]) <= 0.01 * s[0]), None)
            near.append(price) if near else seeds.append([price])
        rows = [(frame["symbol"].iloc[0], round(sum(s) / len(s), 6), len(s)) for s in seeds if len(s) > 1]
        return pd.DataFrame(rows, columns=["symbol", "level", "touches"])

    return swings.groupBy("symbol").applyInPandas(run, "symbol string, level double, touches long")


@query("f71_swept", f"WITH {ATR}, l AS (SELECT symbol, bar_no, close, atr, max(high) {w(20, 3)} AS level, max(high) {w(3)} AS top FROM a) SELECT symbol, bar_no, coalesce(top > level + 0.5 * atr AND close < level, false) AS swept, round(1 / (1 + exp(-(0.4 * sign(level - close) + 0.3 * 2 / 5.0 - 0.3 * abs(level - close) / nullif(atr, 0)))), 6) AS draw FROM l WHERE bar_no > 23")
def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the last three bars went past a level and came back, and how likely the price is drawn to it."""
    b = ranged(spark, sf_dir).withColumn("level", F.max("high").over(last(20, 3))).withColumn("top", F.max("high").over(last(3))).where("bar_no > 23")
    away, a = F.col("level") - C(), F.col("atr")
    draw = 1 / (1 + F.exp(-(0.4 * F.signum(away) + 0.3 * 2 / 5.0 - 0.3 * F.abs(away) / F.nullif(a, F.lit(0.0)))))
    return b.select("symbol", "bar_no", F.coalesce((F.col("top") > F.col("level") + 0.5 * a) & (C() < F.col("level")), F.lit(False)).alias("swept"), F.round(draw, 6).alias("draw"))


@query(
    "f73_heatmap",
    f"WITH {ATR}, n AS (SELECT symbol, arg_max(close, bar_no) AS now, max(bar_no) AS last, arg_max(atr, bar_no) AS atr FROM a GROUP BY 1), s AS (SELECT symbol, round(high / 10) * 10 AS level, max(bar_no) AS seen, count(*) AS touches FROM bars GROUP BY ALL), x AS (SELECT symbol, level, touches, exp(-0.8 * abs(level - now) / atr) * exp(-(last - seen) / 200.0) * least(touches, 5) / 5.0 AS heat FROM s JOIN n USING (symbol)), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(heat, 9) DESC, level) AS k FROM x) SELECT symbol, level, touches, round(heat, 6) AS heat FROM k WHERE k <= 5",
)
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by nearness, age and touches; the five hottest of each symbol (the limit is the feature)."""
    b = ranged(spark, sf_dir)
    now = b.groupBy("symbol").agg(F.max_by("close", "bar_no").alias("now"), F.max("bar_no").alias("last"), F.max_by("atr", F.when(F.col("atr").isNotNull(), F.col("bar_no"))).alias("atr"))
    s = b.groupBy("symbol", (F.round(H() / 10) * 10).alias("level")).agg(F.max("bar_no").alias("seen"), F.count("*").alias("touches"))
    heat = F.exp(-0.8 * F.abs(F.col("level") - F.col("now")) / F.col("atr")) * F.exp(-(F.col("last") - F.col("seen")) / 200.0) * F.least("touches", F.lit(5)) / 5.0
    x = s.join(now, "symbol").withColumn("heat", heat)
    k = x.withColumn("k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc(F.round("heat", 9)), "level")))
    return k.where("k <= 5").select("symbol", "level", "touches", F.round("heat", 6).alias("heat"))


@query("f75_volume_nodes", f"WITH {BARS}, z AS (SELECT symbol, bar_no, close, volume, avg(volume) OVER (PARTITION BY symbol) AS mu FROM bars) SELECT symbol, bar_no, volume > 1.5 * mu AS node, round(close / pow(10, floor(log10(close)))) * pow(10, floor(log10(close))) AS round_level FROM z WHERE close > 0")
def volume_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.pow(F.lit(10.0), F.floor(F.log10("close")))
    return bars(spark, sf_dir).where("close > 0").select("symbol", "bar_no", (V() > 1.5 * F.avg("volume").over(W.partitionBy("symbol"))).alias("node"), (F.round(C() / unit) * unit).alias("round_level"))


@query("f79_streaks", f"WITH {TRADES}, o AS (SELECT strategy, trade_id, line_no, notional, pnl > 0 AS win, row_number() OVER (PARTITION BY strategy ORDER BY {ORDER_SQL}) AS i FROM trades), s AS (SELECT *, i - 1 - coalesce(max(CASE WHEN win THEN i END) OVER (PARTITION BY strategy ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak, count(*) OVER p AS k, avg(win::INT) OVER p AS wr FROM o WINDOW p AS (PARTITION BY strategy ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT strategy, trade_id, line_no, notional, least(streak, 50) AS since_win, round(CASE WHEN k >= 5 THEN wr ELSE 0.5 END, 6) AS recent_rate FROM s")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades since the last win and the win rate of the last twenty, both as known before the trade.

    Trades are numbered over ranges of time; windows then run in runs of numbers, each with the twenty trades before it, and the last win
    before a run comes from a row for each run.
    """
    o = blocks.running_sums(trades(spark, sf_dir).select("strategy", "trade_id", *IN_ORDER), ["strategy"], IN_ORDER, {"i": F.lit(1)}).withColumn("win", (F.col("pnl") > 0).cast("int"))
    o = staged(o.select("strategy", "trade_id", "line_no", "notional", "win", "i"), "numbered-trades")
    run = F.floor((F.col("i") - 1) / RUN)
    wins = o.groupBy("strategy", run.alias("run")).agg(F.max(F.when(F.col("win") == 1, F.col("i"))).alias("last"))
    carried = wins.select("strategy", "run", F.max("last").over(W.partitionBy("strategy").orderBy("run").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    each = o.withColumn("run", F.explode(F.sequence(run, F.floor((F.col("i") + 19) / RUN)))).join(carried, ["strategy", "run"], "left")
    by = W.partitionBy("strategy", "run").orderBy("i")
    before, p = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(-20, -1)
    streak = F.col("i") - 1 - F.coalesce(F.max(F.when(F.col("win") == 1, F.col("i"))).over(before), F.col("carried"), F.lit(0))
    rate = F.when(F.count("*").over(p) >= 5, F.avg("win").over(p)).otherwise(0.5)
    out = each.withColumn("since_win", F.least(streak, F.lit(50))).withColumn("recent_rate", F.round(rate, 6)).where(run == F.col("run"))
    return out.select("strategy", "trade_id", "line_no", "notional", "since_win", "recent_rate")


@query("f80_trailing_losses", f"WITH {TRADES}, o AS (SELECT strategy, pnl > 0 AS win, row_number() OVER (PARTITION BY strategy ORDER BY {ORDER_SQL}) AS i FROM trades) SELECT strategy, max(i) - coalesce(max(i) FILTER (win), 0) AS losses FROM o GROUP BY 1")
def trailing_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many trades came after the latest win: a maximum by strategy, and a count of what lies beyond it."""
    o = staged(trades(spark, sf_dir).select("strategy", F.struct(*IN_ORDER).alias("at"), (F.col("pnl") > 0).alias("win")), "trades-in-order")
    won = F.broadcast(o.groupBy("strategy").agg(F.max(F.when(F.col("win"), F.col("at"))).alias("won")))  # a row a strategy
    after = o.join(won, "strategy").groupBy("strategy").agg(F.count_if(F.col("won").isNull() | (F.col("at") > F.col("won"))).alias("losses"))
    return after


@query("f83_rolling_correlation", f"WITH {BARS}, x AS (SELECT ts, close AS a FROM bars WHERE symbol = 'click'), y AS (SELECT ts, close AS b FROM bars WHERE symbol = 'purchase'), j AS (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM x JOIN y USING (ts)), c AS (SELECT *, corr(a, b) OVER v AS c, a / lag(a, 5) OVER (ORDER BY i) - 1 AS da, b / lag(b, 5) OVER (ORDER BY i) - 1 AS db FROM j WINDOW v AS (ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT ts, round(CASE WHEN i >= 20 THEN c END, 5) AS corr, coalesce(abs(da) >= 0.04 AND abs(db) < abs(da) / 2, false) AS lagging FROM c")
def rolling_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of two series (two symbols, one ordered frame) and whether one has not followed the other's move."""
    both = bars(spark, sf_dir).where(F.col("symbol").isin("click", "purchase")).groupBy("ts").agg(*(F.max(F.when(F.col("symbol") == s, C())).alias(c) for s, c in (("click", "a"), ("purchase", "b")))).dropna()
    by = W.orderBy("ts")
    frame = by.rowsBetween(-19, 0)
    da, db = F.col("a") / F.lag("a", 5).over(by) - 1, F.col("b") / F.lag("b", 5).over(by) - 1
    return both.select("ts", F.round(F.when(F.row_number().over(by) >= 20, m.correlation("a", "b", frame)), 5).alias("corr"), F.coalesce((F.abs(da) >= 0.04) & (F.abs(db) < F.abs(da) / 2), F.lit(False)).alias("lagging"))


@query("f84_cross_section", f"WITH {BARS}, r AS (SELECT symbol, ts, close / lag(close, 5) {OVER} - 1 AS x FROM bars), k AS (SELECT symbol, ts, rank() OVER (PARTITION BY ts ORDER BY x DESC) AS k FROM r WHERE x IS NOT NULL) SELECT symbol, ts, k AS strength FROM k")
def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bars(spark, sf_dir).select("symbol", "ts", (C() / prev("close", 5) - 1).alias("x")).where("x is not null")
    return r.select("symbol", "ts", F.rank().over(W.partitionBy("ts").orderBy(F.desc("x"))).alias("strength"))


@query(
    "f85_reversion_features",
    f"WITH {ATR}, {MACRO_AT}, g AS (SELECT a.*, x.value FROM a ASOF LEFT JOIN mac x ON a.ts >= x.ts) SELECT symbol, bar_no, round((open - {lag('close')}) / nullif(atr, 0), 5) AS gap, {', '.join(f'round((close - {full('avg', 'close', n)}) / nullif({full('stddev_samp', 'close', n)}, 0), 5) AS z{n}' for n in (20, 50, 100))}, round((volume - {full('avg', 'volume', 20)}) / nullif({full('stddev_samp', 'volume', 20)}, 0), 5) AS volume_z, round((close - {full('avg', 'close', 20)}) / nullif(atr, 0), 5) AS distance, round(value, 5) AS macro FROM g",
)
def reversion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap, distances from means and volume of each bar, with the macro value of its day."""
    b = with_macro(spark, sf_dir).withColumn("tr", true_range()).withColumn("atr", mean("tr", 14))
    z = [F.round(ratio(C() - mean("close", n), std("close", n)), 5).alias(f"z{n}") for n in (20, 50, 100)]
    a = F.col("atr")
    return b.select("symbol", "bar_no", F.round(ratio(O() - prev("close"), a), 5).alias("gap"), *z, F.round(ratio(V() - mean("volume", 20), std("volume", 20)), 5).alias("volume_z"), F.round(ratio(C() - mean("close", 20), a), 5).alias("distance"), F.round("value", 5).alias("macro"))


@query("f86_clipped_features", f"WITH {BARS}, g AS (SELECT *, high - low AS rg FROM bars), x AS (SELECT symbol, bar_no, (rg - {full('avg', 'rg', 20)}) / nullif({full('stddev_samp', 'rg', 20)}, 0) AS a, (close - {lag('close', 10)}) / nullif({full('avg', 'rg', 14)}, 0) AS b FROM g) SELECT symbol, bar_no, round(least(greatest(coalesce(last_value(a IGNORE NULLS) OVER f, 0), -5), 5), 5) AS range_z, round(least(greatest(coalesce(last_value(b IGNORE NULLS) OVER f, 0), -5), 5), 5) AS momentum FROM x WINDOW f AS (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING)")
def clipped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores carried over gaps, zero before the first one, cut at five."""
    g = bars(spark, sf_dir).withColumn("rg", H() - L())
    g = g.withColumn("a", ratio(F.col("rg") - mean("rg", 20), std("rg", 20))).withColumn("b", ratio(C() - prev("close", 10), mean("rg", 14)))
    keep = lambda c: F.round(F.least(F.greatest(F.coalesce(F.last(c, ignorenulls=True).over(BY().rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)), F.lit(-5.0)), F.lit(5.0)), 5)
    return g.select("symbol", "bar_no", keep("a").alias("range_z"), keep("b").alias("momentum"))


@query("f87_commitment", f"WITH {ATR}, c AS (SELECT symbol, bar_no, CASE WHEN close > open THEN least(volume / nullif({full('avg', 'volume', 20)}, 0), 2) * 0.25 ELSE 0 END AS vol, CASE WHEN avg(tr) {w(5)} > 1.2 * avg(tr) {w(20)} THEN 0.25 WHEN avg(tr) {w(5)} > avg(tr) {w(20)} THEN 0.15 ELSE 0 END AS rng FROM a) SELECT symbol, bar_no, round(coalesce(vol, 0) + rng, 6) AS score FROM c")
def commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = F.when(C() > O(), F.least(ratio(V(), mean("volume", 20)), F.lit(2.0)) * 0.25).otherwise(0.0)
    fast, slow = F.avg("tr").over(last(5)), F.avg("tr").over(last(20))
    rng = F.when(fast > 1.2 * slow, 0.25).when(fast > slow, 0.15).otherwise(0.0)
    vol = F.when((C() > O()) & mean("volume", 20).isNull(), 0.0).otherwise(F.coalesce(vol, F.lit(0.0)))
    return ranged(spark, sf_dir).select("symbol", "bar_no", F.round(vol + rng, 6).alias("score"))


SQL["f87_commitment"] = SQL["f87_commitment"].replace("CASE WHEN close > open THEN least", f"CASE WHEN close > open AND {full('avg', 'volume', 20)} IS NOT NULL THEN least")


@query("f88_opening_trap", f"WITH {BARS}, k AS (SELECT *, ts::DATE AS day, row_number() OVER d AS k, count(*) OVER (PARTITION BY symbol, ts::DATE) AS n FROM bars WINDOW d AS (PARTITION BY symbol, ts::DATE ORDER BY ts)), r AS (SELECT symbol, day, max(high) FILTER (k <= n // 5) AS hi, min(low) FILTER (k <= n // 5) AS lo, max(high) FILTER (k > n // 5) AS th, min(low) FILTER (k > n // 5) AS tl, arg_max(close, k) AS c FROM k GROUP BY ALL) SELECT symbol, day, CASE WHEN th > hi AND c < hi THEN 'UP_TRAP' WHEN tl < lo AND c > lo THEN 'DOWN_TRAP' ELSE 'NONE' END AS pattern FROM r")
def opening_trap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifth of a day's bars is left and come back to; the upper side is looked at first."""
    w_ = W.partitionBy("symbol", F.to_date("ts"))
    k = bars(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("k", F.row_number().over(w_.orderBy("ts"))).withColumn("early", F.col("k") <= F.floor(F.count("*").over(w_) / 5))
    r = k.groupBy("symbol", "day").agg(F.max(F.when(F.col("early"), H())).alias("hi"), F.min(F.when(F.col("early"), L())).alias("lo"), F.max(F.when(~F.col("early"), H())).alias("th"), F.min(F.when(~F.col("early"), L())).alias("tl"), F.max_by("close", "k").alias("c"))
    return r.select("symbol", "day", F.when((F.col("th") > F.col("hi")) & (F.col("c") < F.col("hi")), "UP_TRAP").when((F.col("tl") < F.col("lo")) & (F.col("c") > F.col("lo")), "DOWN_TRAP").otherwise("NONE").alias("pattern"))


@query("f89_three_candles", f"WITH {BARS}, s AS (SELECT symbol, bar_no, sign(close - open) AS d FROM bars) SELECT symbol, bar_no, CASE WHEN d = lag(d, 1) {OVER} AND d = lag(d, 2) {OVER} AND lag(d, 3) {OVER} = -d THEN d::INT ELSE 0 END AS block FROM s")
def three_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candles of one colour after one of the other."""
    s = bars(spark, sf_dir).withColumn("d", F.signum(C() - O()))
    d = F.col("d")
    hit = (d == prev("d", 1)) & (d == prev("d", 2)) & (prev("d", 3) == -d)
    return s.select("symbol", "bar_no", F.when(hit, d.cast("int")).otherwise(0).alias("block"))


@query("f91_momentum_size", f"WITH {BARS}, x AS (SELECT symbol, bar_no, sign(close - open) * (close / {lag('close', 5)} - 1) AS mo FROM bars) SELECT symbol, bar_no, CASE WHEN mo < -0.002 THEN 1.25 WHEN mo > 0.002 THEN 0.75 ELSE 1.0 END AS factor FROM x")
def momentum_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More size against the move of the last five bars, less with it."""
    mo = F.signum(C() - O()) * (C() / prev("close", 5) - 1)
    return bars(spark, sf_dir).withColumn("mo", mo).select("symbol", "bar_no", F.when(F.col("mo") < -0.002, 1.25).when(F.col("mo") > 0.002, 0.75).otherwise(1.0).alias("factor"))


@query("f92_sharpe_z", f"WITH {TRADES}, d AS (SELECT regime, exit_ts::DATE AS day, sum(pnl) AS x FROM trades GROUP BY ALL), s AS (SELECT regime, day, CASE WHEN count(*) OVER v = 30 THEN avg(x) OVER v / nullif(stddev_samp(x) OVER v, 0) END AS s FROM d WINDOW v AS (PARTITION BY regime ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT regime, round((arg_max(s, day) - avg(s)) / nullif(stddev_samp(s), 0), 5) AS z FROM s GROUP BY 1")
def sharpe_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirty days' ratio against its own history."""
    d = trades(spark, sf_dir).groupBy("regime", F.to_date("exit_ts").alias("day")).agg(F.sum("pnl").alias("x"))
    v = W.partitionBy("regime").orderBy("day").rowsBetween(-29, 0)
    s = d.withColumn("s", F.when(F.count("*").over(v) == 30, F.avg("x").over(v) / F.nullif(F.stddev_samp("x").over(v), F.lit(0.0))))
    return s.groupBy("regime").agg(F.round((F.max_by("s", F.when(F.col("s").isNotNull(), F.col("day"))) - F.avg("s")) / F.nullif(F.stddev_samp("s"), F.lit(0.0)), 5).alias("z"))


# --- plug-ins


@plugins.signal("turn")
def turn(a):
    """Up after two falling closes, down after two rising ones."""
    d = np.sign(np.diff(a["close"], prepend=np.nan))
    return np.where((d == -1) & (np.roll(d, 1) == -1), 1, np.where((d == 1) & (np.roll(d, 1) == 1), -1, 0))


@query("m01_custom_signal", f"WITH {BARS}, d AS (SELECT symbol, bar_no, sign(close - {lag('close')}) AS d FROM bars) SELECT symbol, bar_no, CASE WHEN d = -1 AND {lag('d')} = -1 THEN 1 WHEN d = 1 AND {lag('d')} = 1 THEN -1 ELSE 0 END AS signal FROM d WHERE bar_no > 1")
def custom_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.with_signal(bars(spark, sf_dir), "turn").where("bar_no > 1").select("symbol", "bar_no", F.col("signal").cast("int").alias("signal"))


SQL["m01_custom_signal"] = SQL["m01_custom_signal"].replace("FROM d WHERE bar_no > 1", "FROM d").replace("WITH ", "SELECT * FROM (WITH ", 1) + ") WHERE bar_no > 1"


@query("m02_plug_in_model", f"WITH {BARS} SELECT symbol, bar_no, round(0.3 * (close - open) / (high - low + 1) + 0.01 * volume, 6) AS p FROM bars")
def plug_in_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any object that predicts from a frame of features."""
    model = lambda f: 0.3 * (f["close"] - f["open"]) / (f["high"] - f["low"] + 1) + 0.01 * f["volume"]
    return bars(spark, sf_dir).select("symbol", "bar_no", F.round(plugins.predict(model, ["open", "high", "low", "close", "volume"]), 6).alias("p"))


@query("m03_lifecycle", f"WITH {BARS}, x AS (SELECT symbol, bar_no, close / {lag('close')} - 1 AS r FROM bars) SELECT symbol, count(*) AS n, round(avg(r), 6) AS mean FROM x WHERE r IS NOT NULL AND abs(r) < 5 GROUP BY 1")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [lambda d: d.withColumn("r", C() / prev("close") - 1), lambda d: d.where("r is not null and abs(r) < 5"), lambda d: d.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean"))]
    return plugins.lifecycle(bars(spark, sf_dir), stages)


@query("m04_rolling_apply", f"WITH {BARS} SELECT symbol, bar_no, round(CASE WHEN bar_no >= 10 THEN max(close) {w(10)} - median(close) {w(10)} END, 6) AS x FROM bars")
def rolling_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plugins.rolling_apply(bars(spark, sf_dir), "close", 10, lambda x: x.max() - np.median(x), "x")
    return out.select("symbol", "bar_no", F.round("x", 6).alias("x"))


@query("m05_feature_registry", "WITH k AS (SELECT o_custkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderpriority AS feature, o_orderstatus AS verdict FROM k WHERE k = 1")
def feature_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only registry: the latest entry of each key counts."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy("o_custkey", F.col("o_orderpriority").alias("feature")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("verdict"))


@query("m06_experiment", f"WITH {TRADES}, a AS (SELECT strategy, count(*) AS n, round(sum(r), 4) AS total FROM trades WHERE r > -2 AND quantity <= 50 GROUP BY 1), b AS (SELECT strategy, count(*) AS n_new, round(sum(r), 4) AS total_new FROM trades WHERE r > -2 AND quantity <= 30 GROUP BY 1) SELECT * FROM a FULL JOIN b USING (strategy)")
def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda d, c: d.where((F.col("r") > c["floor"]) & (F.col("quantity") <= c["most"])).groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.sum("r"), 4).alias("total"))
    return plugins.experiment(trades(spark, sf_dir), {"floor": -2.0, "most": 50.0}, {"most": 30.0}, run, ["strategy"], ["most"])


@query("m07_window_trades", bracket_sql(windows=100))
def window_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a hundred bars expanded into their trades, by symbol and window."""
    from tapewright.operators import simulate
    from tapewright.plans.simulation_queries import OHLC, rounded, signals

    s = signals(spark, sf_dir).withColumn("window_no", F.floor((F.col("bar_no") - 1) / 100))
    return rounded(simulate.trades_of(s, ["symbol", "window_no"], OHLC, simulate.bracket()))


# --- memory, regimes and rolling ranks

LAGS = [10, 20, 40, 80, 160]


@query(
    "f53_hurst_lags",
    f"""WITH {BARS}, r AS (SELECT symbol, bar_no - 2 AS i, ln(close / {lag('close')}) AS x FROM bars), l AS (SELECT symbol, i, x, unnest({LAGS}) AS n FROM r WHERE x IS NOT NULL), k AS (SELECT *, i // n AS chunk FROM l),
    c AS (SELECT symbol, n, chunk, i, x - avg(x) OVER p AS d, stddev_pop(x) OVER p AS s, count(*) OVER p AS m FROM k WINDOW p AS (PARTITION BY symbol, n, chunk)), q AS (SELECT *, sum(d) OVER (PARTITION BY symbol, n, chunk ORDER BY i) AS cum FROM c WHERE m = n),
    rs AS (SELECT symbol, n, chunk, (max(cum) - min(cum)) / nullif(max(s), 0) AS rs FROM q GROUP BY ALL), g AS (SELECT symbol, n, avg(rs) AS rs FROM rs GROUP BY ALL) SELECT symbol, count(*) AS lags, round(regr_slope(ln(rs), ln(n)), 5) AS hurst FROM g WHERE rs > 0 GROUP BY 1""",
)
def hurst_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the rescaled range on the length of the pieces, both as logarithms; whole pieces only."""
    r = bars(spark, sf_dir).select("symbol", (F.col("bar_no") - 2).alias("i"), F.log(C() / prev("close")).alias("x")).where("x is not null")
    k = r.withColumn("n", F.explode(F.array(*map(F.lit, LAGS)))).withColumn("chunk", F.floor(F.col("i") / F.col("n")))
    p = W.partitionBy("symbol", "n", "chunk")
    c = k.withColumn("d", F.col("x") - F.avg("x").over(p)).withColumn("s", F.stddev_pop("x").over(p)).withColumn("m", F.count("*").over(p)).where("m = n")
    q = c.withColumn("cum", F.sum("d").over(p.orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    rs = q.groupBy("symbol", "n", "chunk").agg(((F.max("cum") - F.min("cum")) / F.nullif(F.max("s"), F.lit(0.0))).alias("rs"))
    g = rs.groupBy("symbol", "n").agg(F.avg("rs").alias("rs")).where("rs > 0").select("symbol", F.log("rs").alias("y"), F.log("n").alias("x"))
    return g.groupBy("symbol").agg(F.count("*").alias("lags"), F.round(F.regr_slope("y", "x"), 5).alias("hurst"))


REGIME_BARS = 252  # a fixed value of the survey's F55


@query("f55_two_regimes")
def two_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calm or wild at each bar, by a two-state model of return, its size and the change of volume fitted to the bars up to it."""
    from tapewright.operators import rolling

    r = F.coalesce(C() / prev("close") - 1, F.lit(0.0))
    b = bars(spark, sf_dir).withColumn("ret", r).withColumn("size", F.abs(r)).withColumn("push", F.coalesce(F.log(V() + 1) - F.log(prev("volume") + 1), F.lit(0.0)))
    out = rolling.by_windows(b, ["ret", "size", "push"], ["state", "leave"], REGIME_BARS, rolling.regimes(), first=61)
    out = out.withColumn("wild", F.col("state").cast("int"))
    out = out.withColumn("change", F.when(F.col("wild") != prev("wild"), F.col("bar_no")))
    since = F.col("bar_no") - F.coalesce(F.last("change", ignorenulls=True).over(BY().rowsBetween(W.unboundedPreceding, 0)), F.min("bar_no").over(W.partitionBy("symbol")))
    return out.select("symbol", "bar_no", "wild", F.round("leave", 4).alias("leave"), since.alias("since"))


@query("f57_logistic_fit")
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of the logistic curve through the last 20 sums of directed volume, carried on where none fits, and the sums' acceleration."""
    from tapewright.operators import rolling

    few = lambda agg, x: F.when(F.count(x).over(last(20)) >= 20, agg(x).over(last(20)))
    mean = few(F.avg, "volume")
    above = F.when(mean > 0, V() / mean - 1).otherwise(0.0) * F.coalesce(F.signum(C() - prev("close")), F.lit(0.0))
    b = bars(spark, sf_dir).withColumn("push", F.when(mean.isNotNull(), above)).withColumn("total", few(F.sum, "push"))
    velocity = b.withColumn("velocity", F.col("total") - prev("total", 5))
    accel = velocity.select("symbol", "bar_no", (F.col("velocity") - prev("velocity", 5)).alias("acceleration"))
    fitted = rolling.by_windows(b, ["total"], ["rate", "r2"], 20, rolling.growth())
    # the curve at a bar is that of the bars before it
    out = accel.join(fitted.withColumn("bar_no", F.col("bar_no") + 1), ["symbol", "bar_no"], "left")
    held = F.last("rate", ignorenulls=True).over(BY().rowsBetween(W.unboundedPreceding, 0))
    return out.select("symbol", "bar_no", F.round(held, 5).alias("rate"), F.round("r2", 5).alias("r2"), F.round("acceleration", 5).alias("acceleration"))


@query("f57_logistic_growth", f"WITH {BARS}, v AS (SELECT symbol, bar_no, sum(volume) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS s, volume FROM bars), g AS (SELECT symbol, bar_no, volume / nullif(s, 0) AS y, s FROM v) SELECT symbol, bar_no, round(CASE WHEN bar_no >= 60 THEN regr_intercept(y, s) {w(60)} END, 6) AS rate FROM g")
def logistic_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth rate of accumulated volume under a logistic law: growth over level is a line in the level."""
    v = bars(spark, sf_dir).withColumn("s", F.sum("volume").over(BY().rowsBetween(W.unboundedPreceding, 0))).withColumn("y", V() / F.nullif(F.col("s"), F.lit(0.0)))
    return v.select("symbol", "bar_no", F.round(F.when(F.col("bar_no") >= 60, F.regr_intercept("y", "s").over(last(60))), 6).alias("rate"))


@query("f58_spread_features", f"WITH {MACRO_AT}, s AS (SELECT ts::DATE AS day, value / 1000 - avg(value / 1000) OVER (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS spread FROM mac), d AS (SELECT *, spread - lag(spread, 5) OVER (ORDER BY day) AS d5 FROM s) SELECT day, round(spread, 5) AS spread, round(d5, 5) AS change5, round(d5 - lag(d5, 5) OVER (ORDER BY day), 5) AS curvature, coalesce(spread < 0 AND d5 > 0, false) AS steepening FROM d")
def spread_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spread with its change over five rows, the change of that, and the turn up from below zero; a row a day."""
    from tapewright.sources.market import macro_daily

    by = W.orderBy("day")
    x = F.col("value") / 1000
    s = macro_daily(spark, sf_dir).withColumn("spread", x - F.avg(x).over(by.rowsBetween(-19, 0)))
    s = s.withColumn("d5", F.col("spread") - F.lag("spread", 5).over(by))
    return s.select("day", F.round("spread", 5).alias("spread"), F.round("d5", 5).alias("change5"), F.round(F.col("d5") - F.lag("d5", 5).over(by), 5).alias("curvature"), F.coalesce((F.col("spread") < 0) & (F.col("d5") > 0), F.lit(False)).alias("steepening"))


def frame_rank(x: str, n: int) -> F.Column:
    """Rank of the current value in its frame, ties at their mean rank."""
    xs = F.collect_list(x).over(last(n))
    return F.when(F.count(x).over(last(n)) == n, F.size(F.filter(xs, lambda v: v < F.col(x))) + (F.size(F.filter(xs, lambda v: v == F.col(x))) + 1) / 2)


@query(
    "f77_rolling_ic",
    f"WITH {BARS}, x AS (SELECT symbol, bar_no, close / {lag('close', 5)} - 1 AS f, {lag('close')} / {lag('close', 2)} - 1 AS r FROM bars), l AS (SELECT *, count(f) {w(30)} AS nf, count(r) {w(30)} AS nr, list(f) FILTER (f IS NOT NULL) {w(30)} AS fs, list(r) FILTER (r IS NOT NULL) {w(30)} AS rs FROM x), k AS (SELECT symbol, bar_no, CASE WHEN nf = 30 THEN len(list_filter(fs, lambda v: v < f)) + (len(list_filter(fs, lambda v: v = f)) + 1) / 2.0 END AS a, CASE WHEN nr = 30 THEN len(list_filter(rs, lambda v: v < r)) + (len(list_filter(rs, lambda v: v = r)) + 1) / 2.0 END AS b FROM l) SELECT symbol, bar_no, round(CASE WHEN bar_no >= 64 THEN corr(a, b) {w(30)} END, 5) AS ic FROM k",
)
def rolling_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation over thirty bars of ranks within thirty bars."""
    x = bars(spark, sf_dir).withColumn("f", C() / prev("close", 5) - 1).withColumn("r", prev("close") / prev("close", 2) - 1)
    k = x.withColumn("a", frame_rank("f", 30)).withColumn("b", frame_rank("r", 30))
    return k.select("symbol", "bar_no", F.round(F.when(F.col("bar_no") >= 64, m.correlation("a", "b", last(30))), 5).alias("ic"))

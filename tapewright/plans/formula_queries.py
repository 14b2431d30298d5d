"""Text, calendar, sizing, option and macro formulas applied to tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions.frames import mean, prev, std
from tapewright.operators import metrics as m
from tapewright.operators import scalars as s
from tapewright.plans.gate_queries import FEATURES, features
from tapewright.plans.registry import Registry
from tapewright.plans.sql import BARS, MACRO, TICKS, TRADES, full, lag
from tapewright.sources.market import bars, macro_daily, table, ticks, trades

query = Registry()
QUERIES, SQL = query.queries, query.sql

GOOD = "great good strong win best".split()
BAD = "bad weak loss fail worst".split()
FOCUS = "error cache index table model".split()


def words_in(words: list[str]) -> F.Column:
    return F.size(F.array_intersect("ws", F.array(*map(F.lit, words))))


@query("i01_sentiment", f"WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_intersect(ws, {GOOD})) AS good, len(list_intersect(ws, {BAD})) AS bad FROM w")
def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("ws"))
    return d.select("doc_id", words_in(GOOD).alias("good"), words_in(BAD).alias("bad"))


@query("i02_tickers", f"WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[$]([A-Z]{{1,5}})', 1)) AS tagged, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(tagged, list_transform(list_intersect(ws, {FOCUS}), lambda x: upper(x))))), ',') AS tickers FROM w")
def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    tagged = F.regexp_extract_all("text", F.lit(r"[$]([A-Z]{1,5})"), 1)
    named = F.transform(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)), F.array(*map(F.lit, FOCUS))), F.upper)
    return d.select("doc_id", F.array_join(F.sort_array(F.array_distinct(F.concat(tagged, named))), ",").alias("tickers"))


@query("i03_headline_polarity", "WITH h AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS h FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, 0.15 * (contains(h, 'win')::INT + contains(h, 'good')::INT + contains(h, 'gain')::INT) - 0.15 * (contains(h, 'loss')::INT + contains(h, 'bad')::INT + contains(h, 'err')::INT) AS score FROM h) SELECT doc_id, round(score, 4) AS score, CASE WHEN score > 0.1 THEN 'POSITIVE' WHEN score < -0.1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label FROM p")
def headline_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword boosts on a headline (a text's whole first line), by substring."""
    return polarity(table(spark, sf_dir, "documents"), F.substring_index("text", "\n", 1))


@query("i03_whole_text_polarity", "WITH h AS (SELECT doc_id, lower(text) AS h FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, 0.15 * (contains(h, 'win')::INT + contains(h, 'good')::INT + contains(h, 'gain')::INT) - 0.15 * (contains(h, 'loss')::INT + contains(h, 'bad')::INT + contains(h, 'err')::INT) AS score FROM h) SELECT doc_id, round(score, 4) AS score, CASE WHEN score > 0.1 THEN 'POSITIVE' WHEN score < -0.1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label FROM p")
def whole_text_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polarity(table(spark, sf_dir, "documents"), F.col("text"))


def polarity(df: DataFrame, text: Column) -> DataFrame:
    h = df.where("text is not null").select("doc_id", F.lower(text).alias("h"))
    count = lambda ws: sum((F.contains("h", F.lit(w)).cast("int") for w in ws), F.lit(0))
    p = h.select("doc_id", (0.15 * count(["win", "good", "gain"]) - 0.15 * count(["loss", "bad", "err"])).alias("score"))
    return p.select("doc_id", F.round("score", 4).alias("score"), F.when(F.col("score") > 0.1, "POSITIVE").when(F.col("score") < -0.1, "NEGATIVE").otherwise("NEUTRAL").alias("label"))


@query("i04_parsed_labels", r"WITH l AS (SELECT c_custkey, 'similarity: ' || round(c_acctbal / 100, 2) || '% to ' || c_name AS t FROM customer) SELECT c_custkey, try_cast(regexp_extract(t, 'similarity: (-?[0-9.]+)%', 1) AS DOUBLE) AS similarity, try_cast(nullif(regexp_extract(t, '#0*([1-9][0-9]*)', 1), '') AS INT) AS number FROM l")
def parsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("similarity: "), F.round(F.col("c_acctbal") / 100, 2).cast("string"), F.lit("% to "), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract(t, r"similarity: (-?[0-9.]+)%", 1).try_cast("double").alias("similarity"), F.regexp_extract(t, "#0*([1-9][0-9]*)", 1).try_cast("int").alias("number"))


@query("i06_gate_key", f"WITH {TRADES}, g AS (SELECT ' ' || regime || ' : ' || strategy AS raw FROM trades) SELECT trim(split_part(raw, ':', 1)) AS gate, count(*) AS n FROM g GROUP BY 1")
def gate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("regime"), F.lit(" : "), F.col("strategy"))
    return trades(spark, sf_dir).groupBy(F.trim(F.split_part(raw, F.lit(":"), F.lit(1))).alias("gate")).agg(F.count("*").alias("n"))


@query(
    "i07_calendar_features",
    "SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 5 THEN 'EARLY' WHEN day(o_orderdate) <= 10 THEN 'FIRST_THIRD' WHEN day(o_orderdate) <= 20 THEN 'MIDDLE' WHEN day(o_orderdate) <= 25 THEN 'LATE' ELSE 'MONTH_END' END AS part, CASE WHEN month(o_orderdate) = 8 THEN 0.5 ELSE 1.0 END AS factor, month(o_orderdate) = 3 AND day(o_orderdate) BETWEEN 10 AND 31 AS repatriation, month(o_orderdate) IN (1, 4, 7, 10) AND day(o_orderdate) <= 5 AS after_quarter FROM orders",
)
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, mo = F.dayofmonth("o_orderdate"), F.month("o_orderdate")
    part = F.when(d <= 5, "EARLY").when(d <= 10, "FIRST_THIRD").when(d <= 20, "MIDDLE").when(d <= 25, "LATE").otherwise("MONTH_END")
    return table(spark, sf_dir, "orders").select("o_orderkey", part.alias("part"), F.when(mo == 8, 0.5).otherwise(1.0).alias("factor"), ((mo == 3) & d.between(10, 31)).alias("repatriation"), (mo.isin(1, 4, 7, 10) & (d <= 5)).alias("after_quarter"))


@query("i08_first_per_period", "WITH k AS (SELECT o_custkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), quarter(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT o_custkey, y::INT AS y, q::INT AS q, o_orderkey FROM k WHERE k = 1")
def first_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("i09_third_friday", "SELECT o_orderkey, (date_trunc('month', o_orderdate) + to_days(CAST((5 - isodow(date_trunc('month', o_orderdate)) + 7) % 7 + 14 AS INTEGER)))::DATE AS opex FROM orders")
def third_friday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", s.opex(F.to_date("o_orderdate")).alias("opex"))


@query("i10_month_starts", f"WITH {MACRO} SELECT m.day::DATE AS day, round(m.value, 6) AS value FROM macro m JOIN (SELECT min(day) AS day FROM macro WHERE isodow(day) < 6 GROUP BY date_trunc('month', day)) f USING (day)")
def month_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = macro_daily(spark, sf_dir).where(F.weekday("day") < 5)
    return d.groupBy(F.trunc("day", "month").alias("m")).agg(F.min(F.struct("day", "value")).alias("f")).select("f.day", F.round("f.value", 6).alias("value"))


@query("i11_surprise", f"WITH {MACRO}, l AS (SELECT date_trunc('month', day) AS mo, arg_max(value, day) AS v FROM macro GROUP BY 1), p AS (SELECT mo, v, avg(v) OVER w AS base, count(v) OVER w AS n FROM l WINDOW w AS (ORDER BY mo ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) SELECT mo::DATE AS month, round(v - base, 5) AS surprise, CASE WHEN v > base THEN -1 WHEN v < base THEN 1 ELSE 0 END AS fade FROM p WHERE n = 12")
def surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each month against the twelve before; a series of months is a handful of rows."""
    last = macro_daily(spark, sf_dir).groupBy(F.trunc("day", "month").alias("month")).agg(F.max_by("value", "day").alias("v"))
    w = W.orderBy("month").rowsBetween(-12, -1)
    p = last.withColumn("base", F.avg("v").over(w)).withColumn("n", F.count("v").over(w)).where("n = 12")
    return p.select("month", F.round(F.col("v") - F.col("base"), 5).alias("surprise"), (-F.signum(F.col("v") - F.col("base"))).cast("int").alias("fade"))


@query("i12_fair_value", f"WITH {BARS}, f AS (SELECT symbol, bar_no, close * 1.05 / 1.02 AS fair, (close - {full('avg', 'close', 60)}) / nullif({full('stddev_samp', 'close', 60)}, 0) AS z FROM bars) SELECT symbol, bar_no, round(fair, 6) AS fair, round(z, 6) AS z, CASE WHEN z IS NULL THEN 'NONE' WHEN z > 1 THEN 'SHORT' WHEN z < -1 THEN 'LONG' ELSE 'SKIP' END AS signal FROM f")
def fair_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity value at base and quote rates of 2 and 5 %, and the distance from the mean that says whether to trade it."""
    c = F.col("close")
    f = bars(spark, sf_dir).select("symbol", "bar_no", F.round(c * 1.05 / 1.02, 6).alias("fair"), ((c - mean("close", 60)) / F.nullif(std("close", 60), F.lit(0.0))).alias("z"))
    return f.select("symbol", "bar_no", "fair", F.round("z", 6).alias("z"), F.when(F.col("z").isNull(), "NONE").when(F.col("z") > 1, "SHORT").when(F.col("z") < -1, "LONG").otherwise("SKIP").alias("signal"))


COUNTRY = "c AS (SELECT c_nationkey AS k, avg(c_acctbal) / 1000 AS growth, stddev_samp(c_acctbal) / 1000 AS inflation, count(*) / 10.0 AS jobs FROM customer GROUP BY 1)"


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.avg("c_acctbal") / 1000).alias("growth"), (F.stddev_samp("c_acctbal") / 1000).alias("inflation"), (F.count("*") / 10.0).alias("jobs"))


@query("i13_cycle_phase", f"WITH {COUNTRY} SELECT k, CASE WHEN growth > 4.5 AND inflation < 3 THEN 'EXPANSION' WHEN growth > 4.5 THEN 'OVERHEATING' WHEN inflation > 3.2 THEN 'STAGFLATION' ELSE 'SLOWDOWN' END AS phase, round(least(greatest(growth - inflation, -3), 3), 6) AS score FROM c")
def cycle_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, i = F.col("growth"), F.col("inflation")
    phase = F.when((g > 4.5) & (i < 3), "EXPANSION").when(g > 4.5, "OVERHEATING").when(i > 3.2, "STAGFLATION").otherwise("SLOWDOWN")
    return countries(spark, sf_dir).select("k", phase.alias("phase"), F.round(s.clip(g - i, -3.0, 3.0), 6).alias("score"))


@query("i14_macro_composite", f"WITH {COUNTRY}, x AS (SELECT *, 0.4 * least(greatest((growth - 4.5) / 2, -1), 1) + 0.35 * least(greatest((2.9 - inflation) / 2, -1), 1) + 0.25 * least(greatest((jobs - 6) / 4, -1), 1) AS score FROM c) SELECT k, round(score, 6) AS score, CASE WHEN jobs > 7 AND score < 0 THEN 'OVERRIDE' WHEN score > 0.1 THEN 'LONG' WHEN score < -0.1 THEN 'SHORT' ELSE 'FLAT' END AS signal FROM x")
def macro_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = countries(spark, sf_dir)
    score = 0.4 * s.clip((F.col("growth") - 4.5) / 2, -1.0, 1.0) + 0.35 * s.clip((2.9 - F.col("inflation")) / 2, -1.0, 1.0) + 0.25 * s.clip((F.col("jobs") - 6) / 4, -1.0, 1.0)
    x = c.withColumn("score", score)
    return x.select("k", F.round("score", 6).alias("score"), F.when((F.col("jobs") > 7) & (F.col("score") < 0), "OVERRIDE").when(F.col("score") > 0.1, "LONG").when(F.col("score") < -0.1, "SHORT").otherwise("FLAT").alias("signal"))


@query("i15_carry", f"WITH {FEATURES} SELECT symbol, bar_no, CASE WHEN round((close - 100) * 10, 4) >= 150 THEN 1 WHEN round((close - 100) * 10, 4) <= -150 THEN -1 ELSE 0 END AS side, round(0.01 / nullif(atr_pct, 0), 6) AS size FROM feats")
def carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A side where the spread in basis points is wide enough, sized by the inverse of the range."""
    bps = F.round((F.col("close") - 100) * 10, 4)
    return features(spark, sf_dir).select("symbol", "bar_no", F.when(bps >= 150, 1).when(bps <= -150, -1).otherwise(0).alias("side"), F.round(0.01 / F.nullif(F.col("atr_pct"), F.lit(0.0)), 6).alias("size"))


@query("i16_smile", f"WITH {BARS}, z AS (SELECT symbol, bar_no, (close - {full('avg', 'close', 100)}) / nullif({full('stddev_samp', 'close', 100)}, 0) AS z, high - low AS stress FROM bars) SELECT symbol, bar_no, CASE WHEN z IS NULL THEN 1.0 WHEN z > 1 AND stress > 100 THEN 1.2 WHEN z < -1 AND stress > 100 THEN 0.8 WHEN z > 1 THEN 1.1 WHEN abs(z) <= 1 AND stress < 30 THEN 0.9 ELSE 1.0 END AS factor FROM z")
def smile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("close")
    z = bars(spark, sf_dir).select("symbol", "bar_no", ((c - mean("close", 100)) / F.nullif(std("close", 100), F.lit(0.0))).alias("z"), F.round(F.col("high") - F.col("low"), 9).alias("stress"))
    x, stress = F.col("z"), F.col("stress")
    return z.select("symbol", "bar_no", F.when(x.isNull(), 1.0).when((x > 1) & (stress > 100), 1.2).when((x < -1) & (stress > 100), 0.8).when(x > 1, 1.1).when((F.abs(x) <= 1) & (stress < 30), 0.9).otherwise(1.0).alias("factor"))


@query("i17_regime_axes", f"WITH {FEATURES} SELECT symbol, bar_no, CASE WHEN atr_pct <= 0.3 THEN 1 WHEN atr_pct <= 0.6 THEN 2 WHEN atr_pct <= 0.9 THEN 3 ELSE 4 END AS volatility, CASE WHEN z > 1 THEN 'STRONG_TREND' WHEN z > 0.3 THEN 'WEAK_TREND' WHEN z >= -0.3 THEN 'RANGE' ELSE 'DOWN' END AS trend, CASE WHEN rsi > 60 THEN 'RISK_ON' WHEN rsi < 40 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS appetite FROM feats WHERE rsi IS NOT NULL AND z IS NOT NULL")
def regime_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).where("rsi is not null and z is not null")
    vol = s.ladder(F.col("atr_pct"), [(0.3, 1), (0.6, 2), (0.9, 3)], 4)
    z = F.col("z")
    return f.select("symbol", "bar_no", vol.alias("volatility"), F.when(z > 1, "STRONG_TREND").when(z > 0.3, "WEAK_TREND").when(z >= -0.3, "RANGE").otherwise("DOWN").alias("trend"), F.when(F.col("rsi") > 60, "RISK_ON").when(F.col("rsi") < 40, "RISK_OFF").otherwise("NEUTRAL").alias("appetite"))


@query("i18_regime_label", f"WITH {FEATURES}, h AS (SELECT symbol, bar_no, 0.5 + z / 20 AS h FROM feats) SELECT symbol, bar_no, CASE WHEN h IS NULL THEN 'FLAT' WHEN h > 0.52 THEN 'MOMENTUM' WHEN h < 0.45 THEN 'REVERSION' ELSE 'FLAT' END AS label FROM h")
def regime_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = 0.5 + F.col("z") / 20
    return features(spark, sf_dir).select("symbol", "bar_no", F.when(h > 0.52, "MOMENTUM").when(h < 0.45, "REVERSION").otherwise("FLAT").alias("label"))


EDGE = f"{TRADES}, g AS (SELECT strategy, regime, count(*) AS n, avg((r > 0)::INT) AS p, avg(r) FILTER (r > 0) AS win, -avg(r) FILTER (r <= 0) AS loss FROM trades GROUP BY ALL)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r")
    return trades(spark, sf_dir).groupBy("strategy", "regime").agg(F.count("*").alias("n"), m.win_rate("r").alias("p"), F.avg(F.when(r > 0, r)).alias("win"), (-F.avg(F.when(r <= 0, r))).alias("loss"))


@query("i19_kelly", f"WITH {EDGE} SELECT strategy, regime, round(coalesce(least(greatest((p * (win / nullif(loss, 0)) - (1 - p)) / nullif(win / nullif(loss, 0), 0), 0), 0.25), 0), 6) AS fraction, round(CASE WHEN p * win - (1 - p) * loss <= 0 THEN 0 ELSE least(greatest((p * (win / nullif(loss, 0)) - (1 - p)) / nullif(win / nullif(loss, 0), 0) / 4, 0.005), 0.04) END, 6) AS quarter FROM g")
def kelly(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("win") / F.nullif(F.col("loss"), F.lit(0.0))
    raw = (F.col("p") * b - (1 - F.col("p"))) / F.nullif(b, F.lit(0.0))
    quarter = F.when(F.col("p") * F.col("win") - (1 - F.col("p")) * F.col("loss") <= 0, 0.0).otherwise(s.clip(raw / 4, 0.005, 0.04))
    return edges(spark, sf_dir).select("strategy", "regime", F.round(s.kelly(F.col("p"), F.col("win"), F.col("loss")), 6).alias("fraction"), F.round(quarter, 6).alias("quarter"))


@query("i20_hoeffding", f"WITH {EDGE} SELECT strategy, regime, round(least(greatest(p - sqrt(ln(2 / (1 - 0.95)) / (2 * n)), 0), 1), 6) AS lower_bound, ceil(ln(2 / (1 - 0.95)) / (2 * 0.05 * 0.05))::BIGINT AS needed FROM g")
def hoeffding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("strategy", "regime", F.round(s.hoeffding(F.col("p"), F.col("n")), 6).alias("lower_bound"), s.sample_complexity(F.lit(0.05)).alias("needed"))


@query("i21_expected_value", f"WITH {EDGE} SELECT strategy, regime, round(p * win - (1 - p) * loss, 6) AS ev, round(loss / nullif(win + loss, 0), 6) AS break_even FROM g")
def expected_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, even = s.expected_value(F.col("p"), F.col("win"), F.col("loss"))
    return edges(spark, sf_dir).select("strategy", "regime", F.round(ev, 6).alias("ev"), F.round(even, 6).alias("break_even"))


@query(
    "i22_stops_targets",
    f"WITH {BARS}, g AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, sign(close - open) AS d FROM bars), a AS (SELECT *, {full('avg', 'tr', 14)} AS atr FROM g), t AS (SELECT *, CASE WHEN d > 0 THEN greatest(close - 1.5 * atr, low) ELSE least(close + 1.5 * atr, high) END AS stop FROM a WHERE atr IS NOT NULL AND d <> 0) SELECT symbol, bar_no, round(stop, 6) AS stop, round(close + d * abs(close - stop), 6) AS t1, round(close + 2 * d * abs(close - stop), 6) AS t2, round(close + 3 * d * abs(close - stop), 6) AS t3 FROM t",
)
def stops_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tighter of a range stop and a structural one; targets at whole multiples of the risk."""
    from tapewright.functions.frames import true_range

    c, d = F.col("close"), F.signum(F.col("close") - F.col("open"))
    a = bars(spark, sf_dir).withColumn("tr", true_range()).withColumn("atr", mean("tr", 14)).withColumn("d", d).where("atr is not null and d <> 0")
    a = a.withColumn("stop", s.tighter_stop(c, F.col("d"), c - F.col("d") * 1.5 * F.col("atr"), F.when(F.col("d") > 0, F.col("low")).otherwise(F.col("high"))))
    risk = F.abs(c - F.col("stop"))
    return a.select("symbol", "bar_no", F.round("stop", 6).alias("stop"), *(F.round(c + k * F.col("d") * risk, 6).alias(f"t{k}") for k in (1, 2, 3)))


@query("i23_vetoed_sizing", f"WITH {FEATURES}, v AS (SELECT *, CASE WHEN atr IS NULL THEN 'no range' WHEN atr_pct > 1 THEN 'too volatile' WHEN abs(z) > 2.5 THEN 'stretched' END AS veto, 1000 / nullif(1.5 * atr, 0) AS units FROM feats) SELECT symbol, bar_no, veto, CASE WHEN veto IS NULL THEN round(least(units, 300000 / close), 6) ELSE 0 END AS units FROM v")
def vetoed_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by risk, cut to the leverage cap; the first veto sets them to zero."""
    veto = F.when(F.col("atr").isNull(), "no range").when(F.col("atr_pct") > 1, "too volatile").when(F.abs("z") > 2.5, "stretched")
    v = features(spark, sf_dir).withColumn("veto", veto)
    return v.select("symbol", "bar_no", "veto", F.when(F.col("veto").isNull(), F.round(F.least(1000 / F.nullif(1.5 * F.col("atr"), F.lit(0.0)), 300_000 / F.col("close")), 6)).otherwise(0.0).alias("units"))


@query("i24_impact", f"WITH {BARS}, v AS (SELECT symbol, bar_no, volume, close, {full('stddev_samp', 'close', 20)} / close AS sigma FROM bars) SELECT symbol, bar_no, round(0.1 * sigma * sqrt(10 / nullif(volume, 0)), 8) AS impact, round(close * 0.0005, 6) AS fixed FROM v")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bars(spark, sf_dir).withColumn("sigma", std("close", 20) / F.col("close"))
    return v.select("symbol", "bar_no", F.round(s.participation_impact(F.col("sigma"), F.lit(10.0), F.col("volume")), 8).alias("impact"), F.round(F.col("close") * 0.0005, 6).alias("fixed"))


@query("i25_trade_costs", f"WITH {TRADES}, d AS (SELECT trade_id, line_no, notional, pnl, greatest(date_diff('day', entry_ts, exit_ts), 0) AS days FROM trades) SELECT trade_id, line_no, notional, round(pnl - notional * 0.0001 - notional * 0.02 * (days + 2 * (days // 5)) / 365, 6) AS net FROM d")
def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.greatest(F.datediff("exit_ts", "entry_ts"), F.lit(0))
    n = F.col("notional")
    return trades(spark, sf_dir).select("trade_id", "line_no", "notional", F.round(F.col("pnl") - n * 0.0001 - n * 0.02 * s.swap_days(days) / 365, 6).alias("net"))


CDF = "CASE WHEN {x} >= 0 THEN 1 - {t} ELSE {t} END"
TAIL = "exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * (((((1.330274429 * {k} - 1.821255978) * {k} + 1.781477937) * {k} - 0.356563782) * {k} + 0.319381530) * {k})"


def cdf_sql(x: str) -> str:
    return CDF.format(x=x, t=TAIL.format(x=x, k=f"(1 / (1 + 0.2316419 * abs({x})))"))


OPT = "o AS (SELECT p_partkey AS id, p_retailprice AS s, p_retailprice * (0.8 + p_size % 10 * 0.05) AS k, 0.1 + p_size / 50.0 AS t, 0.03 AS r, 0.15 + p_partkey % 7 * 0.05 AS sigma FROM part)"


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), price.alias("s"), (price * (0.8 + size % 10 * 0.05)).alias("k"), (0.1 + size / 50.0).alias("t"), F.lit(0.03).alias("r"), (0.15 + F.col("p_partkey") % 7 * 0.05).alias("sigma"))


@query("i26_option_price", f"WITH {OPT}, d AS (SELECT *, (ln(s / k) + (r + sigma * sigma / 2) * t) / (sigma * sqrt(t)) AS d1 FROM o), e AS (SELECT *, d1 - sigma * sqrt(t) AS d2 FROM d) SELECT id, round(s * ({cdf_sql('d1')}) - k * exp(-r * t) * ({cdf_sql('d2')}), 5) AS price FROM e")
def option_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options(spark, sf_dir).select("id", F.round(s.black_scholes_call(*(F.col(c) for c in ("s", "k", "t", "r", "sigma"))), 5).alias("price"))


@query("i26_implied_volatility", f"WITH {OPT} SELECT id, round(sigma, 3) AS implied FROM o")
def implied_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volatility found from each price is the one that the price was made with."""
    o = options(spark, sf_dir).withColumn("price", s.black_scholes_call(*(F.col(c) for c in ("s", "k", "t", "r", "sigma"))))
    return o.select("id", F.round(s.implied_volatility(*(F.col(c) for c in ("price", "s", "k", "t", "r"))), 3).alias("implied"))


@query("i27_health", f"WITH {EDGE}, h AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END AS e FROM g) SELECT strategy, regime, round(e, 6) AS entropy, round(100 * (0.3 * p + 0.2 * (1 - e) + 0.3 * least(n / 1000.0, 1) + 0.2 * least(greatest(win / nullif(loss, 0) / 3, 0), 1)), 5) AS health FROM h")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.binary_entropy(F.col("p"))
    payoff = s.clip(F.col("win") / F.nullif(F.col("loss"), F.lit(0.0)) / 3, 0.0, 1.0)
    score = 100 * (0.3 * F.col("p") + 0.2 * (1 - e) + 0.3 * F.least(F.col("n") / 1000.0, F.lit(1.0)) + 0.2 * payoff)
    return edges(spark, sf_dir).select("strategy", "regime", F.round(e, 6).alias("entropy"), F.round(score, 5).alias("health"))


@query("i28_deflated_sharpe")
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each setup's Sharpe ratio against the best of as many by chance; tested against the library's normal distribution."""
    g = trades(spark, sf_dir).groupBy("strategy", "regime").agg(F.count("*").alias("n"), m.safe(F.avg("r"), F.stddev_samp("r")).alias("sharpe"))
    everything = W.partitionBy()
    g = g.withColumn("trials", F.count("*").over(everything)).withColumn("spread", F.stddev_samp("sharpe").over(everything))
    hurdle, chance = s.deflated_sharpe(F.col("sharpe"), F.col("trials"), F.col("spread"), F.col("n"))
    return g.select("strategy", "regime", F.round("sharpe", 6).alias("sharpe"), F.round(hurdle, 6).alias("hurdle"), F.round(chance, 6).alias("chance"))


@query(
    "i29_adjusted_p",
    f"WITH {TRADES}, h AS (SELECT strategy || '/' || regime AS hypothesis, least(1, exp(-abs(avg(r) / (stddev_samp(r) / sqrt(count(*)))))) AS p FROM trades GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY p, hypothesis) AS k, count(*) OVER () AS m FROM h), a AS (SELECT *, least(min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS adj FROM k) SELECT hypothesis, round(p, 6) AS p, round(adj, 6) AS adjusted, adj <= 0.1 AS passes FROM a",
)
def adjusted_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = trades(spark, sf_dir).groupBy("strategy", "regime").agg(F.least(F.lit(1.0), F.exp(-F.abs(F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count("*")))))).alias("p"))
    return m.adjusted_p(h.select(F.concat_ws("/", "strategy", "regime").alias("hypothesis"), "p"), "p")


@query("i30_cosine", "WITH c AS (SELECT label AS l, list_transform(generate_series(1, 64), lambda i: 0.0) AS z, avg(embedding[1]) AS a1, avg(embedding[2]) AS a2, avg(embedding[3]) AS a3, avg(embedding[4]) AS a4 FROM embeddings GROUP BY 1) SELECT vec_id, round((embedding[1] * a1 + embedding[2] * a2 + embedding[3] * a3 + embedding[4] * a4) / nullif(sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2 + embedding[4]::DOUBLE ** 2) * sqrt(a1 ** 2 + a2 ** 2 + a3 ** 2 + a4 ** 2), 0), 4) AS similarity FROM embeddings JOIN c ON label = l")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the first four components to the mean vector of the label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("v"))
    centre = e.groupBy("label").agg(F.array(*(F.avg(F.get("v", F.lit(i))) for i in range(4))).alias("c"))
    return e.join(F.broadcast(centre), "label").select("vec_id", F.round(s.cosine("v", "c"), 4).alias("similarity"))


@query("i31_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.missing.deep') AS deep FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing.deep").alias("deep"))


@query("i32_config_override", "SELECT p_partkey AS id, 'stop=' || CASE WHEN p_size > 25 THEN '2.0' ELSE '1.5' END || ';target=3.0;period=' || CASE WHEN p_size > 40 THEN '21' ELSE '14' END AS config FROM part")
def config_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base configuration with each row's changes merged over it; keys outside the scope are ignored."""
    base = {"stop": "1.5", "target": "3.0", "period": "14"}
    given = F.map_concat(
        F.when(F.col("p_size") > 25, F.create_map(F.lit("stop"), F.lit("2.0"))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(F.col("p_size") > 40, F.create_map(F.lit("period"), F.lit("21"))).otherwise(F.create_map(F.lit("secret"), F.lit("x"))),
    )
    merged = [F.concat(F.lit(f"{k}="), F.coalesce(F.try_element_at(F.col("given"), F.lit(k)), F.lit(v))) for k, v in base.items()]
    return table(spark, sf_dir, "part").withColumn("given", given).select(F.col("p_partkey").alias("id"), F.concat_ws(";", *merged).alias("config"))


KNOTS = [(0.0, 1.0), (20.0, 0.8), (60.0, 0.3), (100.0, 0.0)]


@query("i33_interpolation", f"WITH {TICKS} SELECT event_id, round(CASE WHEN size <= 0 THEN 1.0 WHEN size <= 20 THEN 1 - 0.2 * size / 20 WHEN size <= 60 THEN 0.8 - 0.5 * (size - 20) / 40 WHEN size <= 100 THEN 0.3 - 0.3 * (size - 60) / 40 ELSE 0 END, 6) AS weight FROM ticks")
def interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("event_id", F.round(s.interpolate(F.col("size"), KNOTS), 6).alias("weight"))


@query("i34_allocation_caps", f"WITH {EDGE} SELECT strategy, regime, round(CASE WHEN n < 20 THEN 0 ELSE least(1, CASE WHEN p < 0.45 THEN 0.25 WHEN p < 0.5 THEN 0.5 ELSE 1 END, CASE WHEN win < loss THEN 0.6 ELSE 1 END) END, 6) AS allocation FROM g")
def allocation_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_health = F.when(F.col("p") < 0.45, 0.25).when(F.col("p") < 0.5, 0.5).otherwise(1.0)
    by_payoff = F.when(F.col("win") < F.col("loss"), 0.6).otherwise(1.0)
    return edges(spark, sf_dir).select("strategy", "regime", F.when(F.col("n") < 20, 0.0).otherwise(F.least(F.lit(1.0), by_health, by_payoff)).alias("allocation"))


@query("i35_option_layer", f"WITH {OPT}, x AS (SELECT id, s, sigma, CASE WHEN sigma < 0.2 THEN 1 WHEN sigma < 0.3 THEN 0.5 ELSE -1 END AS a, CASE WHEN k < s THEN 1.5 ELSE -1.5 END AS b, CASE WHEN t > 0.6 THEN 1 ELSE 0 END AS c FROM o) SELECT id, round(least(greatest(2 * a + b + c, -3), 3), 4) AS score, round(s * sigma * sqrt(20 / 365.0), 6) AS expected_move FROM x")
def option_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("sigma") < 0.2, 1.0).when(F.col("sigma") < 0.3, 0.5).otherwise(-1.0)
    b, c = F.when(F.col("k") < F.col("s"), 1.5).otherwise(-1.5), F.when(F.col("t") > 0.6, 1.0).otherwise(0.0)
    return options(spark, sf_dir).select("id", s.clip(2 * a + b + c, -3.0, 3.0).alias("score"), F.round(F.col("s") * F.col("sigma") * math.sqrt(20 / 365), 6).alias("expected_move"))


@query("i36_composite_layers", f"WITH {FEATURES}, w AS (SELECT symbol, bar_no, (0.5 * coalesce(z, 0) + 0.3 * coalesce((rsi - 50) / 10, 0) + 0.2 * coalesce((stoch - 50) / 20, 0)) / nullif(CASE WHEN z IS NULL THEN 0 ELSE 0.5 END + CASE WHEN rsi IS NULL THEN 0 ELSE 0.3 END + CASE WHEN stoch IS NULL THEN 0 ELSE 0.2 END, 0) AS score FROM feats) SELECT symbol, bar_no, round(score, 6) AS score, CASE WHEN score IS NULL THEN 'NO_DATA' WHEN score >= 1 THEN 'BULL' WHEN score <= -1 THEN 'BEAR' ELSE 'MIXED' END AS label FROM w")
def composite_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = s.weighted_mean([(F.col("z"), 0.5), ((F.col("rsi") - 50) / 10, 0.3), ((F.col("stoch") - 50) / 20, 0.2)])
    x = features(spark, sf_dir).select("symbol", "bar_no", score.alias("score"))
    return x.select("symbol", "bar_no", F.round("score", 6).alias("score"), F.when(F.col("score").isNull(), "NO_DATA").when(F.col("score") >= 1, "BULL").when(F.col("score") <= -1, "BEAR").otherwise("MIXED").alias("label"))


@query("i37_participants", f"WITH {TICKS}, b AS (SELECT user_id, count(*) AS n, avg(size) AS size, count(DISTINCT symbol) AS kinds FROM ticks GROUP BY 1), p AS (SELECT user_id, 1.0 + (n > 8)::INT * 2 AS hft, 1.0 + (size > 55)::INT * 1.5 AS fund, 1.0 + (kinds < 3)::INT AS retail FROM b) SELECT user_id, round(hft / (hft + fund + retail), 6) AS hft, round(fund / (hft + fund + retail), 6) AS fund, round(retail / (hft + fund + retail), 6) AS retail FROM p")
def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule points over a base of one for each kind of participant, as shares."""
    b = ticks(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("size").alias("size"), F.count_distinct("symbol").alias("kinds"))
    points = {"hft": 1.0 + 2 * (F.col("n") > 8).cast("int"), "fund": 1.0 + 1.5 * (F.col("size") > 55).cast("int"), "retail": 1.0 + (F.col("kinds") < 3).cast("int")}
    total = sum(points.values())
    return b.select("user_id", *(F.round(p / total, 6).alias(k) for k, p in points.items()))


@query("i38_best_model", f"WITH {FEATURES}, c AS (SELECT symbol, bar_no, coalesce(rsi, 0) / 100 AS a, coalesce(stoch, 0) / 110 AS b, 0.5 AS d FROM feats) SELECT symbol, bar_no, CASE WHEN greatest(a, b, d) < 0.55 THEN 'none' WHEN a = greatest(a, b, d) THEN 'rsi' WHEN b = greatest(a, b, d) THEN 'stoch' ELSE 'flat' END AS model, round(greatest(a, b, d), 6) AS score FROM c")
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = [("rsi", F.coalesce("rsi", F.lit(0.0)) / 100, 2), ("stoch", F.coalesce("stoch", F.lit(0.0)) / 110, 1), ("flat", F.lit(0.5), 0)]
    best = F.array_max(F.array(*(F.struct(x.alias("score"), F.lit(k).alias("k"), F.lit(n).alias("model")) for n, x, k in scores)))
    b = features(spark, sf_dir).select("symbol", "bar_no", best.alias("b"))
    return b.select("symbol", "bar_no", F.when(F.col("b.score") < 0.55, "none").otherwise(F.col("b.model")).alias("model"), F.round("b.score", 6).alias("score"))


@query("i39_risk_envelope", f"WITH {FEATURES} SELECT symbol, bar_no, least(CASE WHEN atr_pct > 0.9 THEN 0.25 WHEN atr_pct > 0.6 THEN 0.5 ELSE 1 END, CASE WHEN stoch > 90 THEN 0.5 ELSE 1 END) AS size, least(3, CASE WHEN abs(z) > 2 THEN 1 ELSE 5 END) AS positions FROM feats")
def risk_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_regime = F.when(F.col("atr_pct") > 0.9, 0.25).when(F.col("atr_pct") > 0.6, 0.5).otherwise(1.0)
    by_crowd = F.when(F.col("stoch") > 90, 0.5).otherwise(1.0)
    return features(spark, sf_dir).select("symbol", "bar_no", F.least(by_regime, by_crowd).alias("size"), F.least(F.lit(3), F.when(F.abs("z") > 2, 1).otherwise(5)).alias("positions"))


@query(
    "i40_structural_stop",
    f"WITH {BARS}, g AS (SELECT *, {full('avg', 'close', 14)} * 0.05 AS noise, list(low) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS lows FROM bars), s AS (SELECT *, list_max(list_filter(lows, lambda x: x < close - noise)) AS level FROM g WHERE noise IS NOT NULL) SELECT symbol, bar_no, round(greatest(coalesce(level, close - 2 * noise), close * 0.5), 6) AS stop, CASE WHEN level IS NULL THEN 'range' WHEN level < close * 0.5 THEN 'capped' ELSE 'structure' END AS reason FROM s",
)
def structural_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest recent low outside the noise, else twice the noise; never more than half the price away."""
    w = W.partitionBy("symbol").orderBy("bar_no").rowsBetween(-10, -1)
    c = F.col("close")
    g = bars(spark, sf_dir).withColumn("noise", mean("close", 14) * 0.05).withColumn("lows", F.collect_list("low").over(w)).where("noise is not null")
    g = g.withColumn("level", F.array_max(F.filter("lows", lambda x: x < c - F.col("noise"))))
    stop = F.greatest(F.coalesce("level", c - 2 * F.col("noise")), c * 0.5)
    return g.select("symbol", "bar_no", F.round(stop, 6).alias("stop"), F.when(F.col("level").isNull(), "range").when(F.col("level") < c * 0.5, "capped").otherwise("structure").alias("reason"))


@query("i41_sharpe_interval", f"WITH {TRADES}, g AS (SELECT strategy, count(*) AS n, avg(r) / nullif(stddev_samp(r), 0) AS sr FROM trades GROUP BY 1) SELECT strategy, round(sr, 6) AS sharpe, round(sr - 1.96 * sqrt((1 + sr * sr / 2) / n), 6) AS low, round(sr + 1.96 * sqrt((1 + sr * sr / 2) / n), 6) AS high FROM g")
def sharpe_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trades(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), m.safe(F.avg("r"), F.stddev_samp("r")).alias("sr"))
    sr = F.col("sr")
    half = 1.96 * F.sqrt((1 + sr * sr / 2) / F.col("n"))
    return g.select("strategy", F.round(sr, 6).alias("sharpe"), F.round(sr - half, 6).alias("low"), F.round(sr + half, 6).alias("high"))


@query("i42_alignment", f"WITH {FEATURES}, a AS (SELECT symbol, bar_no, (coalesce(z > 0, false))::INT + (coalesce(rsi > 50, false))::INT + (coalesce(stoch > 50, false))::INT + (coalesce(atr_pct < 0.6, false))::INT AS score FROM feats) SELECT symbol, bar_no, score, round(score / 4.0, 4) AS share, CASE WHEN score >= 3 THEN 'ALIGNED' WHEN score = 2 THEN 'MIXED' ELSE 'AGAINST' END AS verdict FROM a")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = sum((F.coalesce(F.expr(c), F.lit(False)).cast("int") for c in ("z > 0", "rsi > 50", "stoch > 50", "atr_pct < 0.6")), F.lit(0))
    a = features(spark, sf_dir).select("symbol", "bar_no", score.alias("score"))
    return a.select("symbol", "bar_no", "score", F.round(F.col("score") / 4.0, 4).alias("share"), F.when(F.col("score") >= 3, "ALIGNED").when(F.col("score") == 2, "MIXED").otherwise("AGAINST").alias("verdict"))

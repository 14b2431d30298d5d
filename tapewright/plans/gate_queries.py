"""Validation, session filters and gate cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions.frames import highest, lowest, mean, prev, std
from tapewright.operators import gates, matching
from tapewright.plans.join_queries import MACRO_AT, MEETINGS, with_macro
from tapewright.plans.registry import Registry
from tapewright.plans.sql import BARS, TICKS, TRADES, full, lag
from tapewright.sources.market import IN_ORDER, bars, table, ticks, trades

query = Registry()
QUERIES, SQL = query.queries, query.sql

DIRTY = f"{BARS}, dirty AS (SELECT symbol, bar_no, ts, open, CASE WHEN bar_no % 7 = 0 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN bar_no % 11 = 0 THEN NULL WHEN bar_no % 13 = 0 THEN -1 ELSE volume END AS volume FROM bars)"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("bar_no")
    b = bars(spark, sf_dir).withColumn("high", F.when(n % 7 == 0, F.col("low") - 1).otherwise(F.col("high")))
    return b.withColumn("volume", F.when(n % 11 == 0, None).when(n % 13 == 0, -1.0).otherwise(F.col("volume")))


def bar_checks() -> gates.Checks:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return [("high", F.col("high") >= top), ("low", F.col("low") <= bottom), ("volume", F.col("volume") >= 0)]


BAR_ERRORS = "list_filter([CASE WHEN high >= greatest(open, close) THEN NULL ELSE 'high' END, CASE WHEN low <= least(open, close) THEN NULL ELSE 'low' END, CASE WHEN volume >= 0 THEN NULL ELSE 'volume' END], lambda x: x IS NOT NULL)"


@query("a04_raw_bar_counts", f"WITH {DIRTY}, e AS (SELECT symbol, {BAR_ERRORS} AS errors FROM dirty) SELECT symbol, count(*) AS n, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (list_contains(errors, 'high')) AS bad_high, count(*) FILTER (list_contains(errors, 'volume')) AS bad_volume FROM e GROUP BY 1")
def raw_bar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dirty(spark, sf_dir).select("symbol", gates.errors(bar_checks()).alias("errors"))
    return e.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.array_contains("errors", "high")).alias("bad_high"), F.count_if(F.array_contains("errors", "volume")).alias("bad_volume"))


@query("c01_bar_validation", f"WITH {DIRTY} SELECT symbol, bar_no, array_to_string({BAR_ERRORS}, ',') AS errors FROM dirty")
def bar_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).select("symbol", "bar_no", F.array_join(gates.errors(bar_checks()), ",").alias("errors"))


FEATURES = f"""{BARS}, g AS (SELECT *, {lag('close')} AS before, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, greatest(close - {lag('close')}, 0) AS up, greatest({lag('close')} - close, 0) AS down FROM bars),
feats AS (SELECT symbol, bar_no, ts, close, {full('avg', 'tr', 14)} AS atr, {full('avg', 'tr', 14)} / close AS atr_pct, (close - {full('avg', 'close', 20)}) / nullif({full('stddev_samp', 'close', 20)}, 0) AS z, 100 - 100 / (1 + {full('avg', 'up', 14)} / nullif({full('avg', 'down', 14)}, 0)) AS rsi, round(100 * (close - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0), 9) AS stoch FROM g)"""
RANGES = {"atr": (1e-9, None), "atr_pct": (0.0, 0.9), "z": (-3.0, 3.0), "rsi": (0.0, 100.0), "stoch": (5.0, 100.0)}


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.functions.frames import ratio, true_range

    c = F.col("close")
    g = bars(spark, sf_dir).withColumn("tr", true_range()).withColumn("up", F.greatest(c - prev("close"), F.lit(0.0))).withColumn("down", F.greatest(prev("close") - c, F.lit(0.0)))
    return g.select(
        "symbol", "bar_no", "ts", "close", mean("tr", 14).alias("atr"), (mean("tr", 14) / c).alias("atr_pct"), ratio(c - mean("close", 20), std("close", 20)).alias("z"),
        (100 - 100 / (1 + ratio(mean("up", 14), mean("down", 14)))).alias("rsi"), F.round(100 * ratio(c - lowest("low", 14), highest("high", 14) - lowest("low", 14)), 9).alias("stoch"),
    )


def range_errors() -> str:
    parts = (f"CASE WHEN {c} >= {lo if lo is not None else '-1e300'} AND {c} <= {hi if hi is not None else '1e300'} THEN NULL ELSE '{c}' END" for c, (lo, hi) in RANGES.items())
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


@query("c02_feature_validation", f"WITH {FEATURES} SELECT symbol, bar_no, array_to_string({range_errors()}, ',') AS errors, len({range_errors()}) = 0 AS is_valid FROM feats")
def feature_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature against its range; a record is valid exactly if it has no errors."""
    e = features(spark, sf_dir).withColumn("e", gates.errors(gates.in_ranges(RANGES)))
    return e.select("symbol", "bar_no", F.array_join("e", ",").alias("errors"), (F.size("e") == 0).alias("is_valid"))


@query("c03_feature_counters", f"WITH {FEATURES}, e AS (SELECT symbol, {range_errors()} AS e FROM feats) SELECT symbol, count(*) AS total, count(*) FILTER (len(e) = 0) AS valid, count(*) FILTER (len(e) > 0) AS invalid, sum(len(e))::BIGINT AS errors FROM e GROUP BY 1")
def feature_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = features(spark, sf_dir).withColumn("e", F.size(gates.errors(gates.in_ranges(RANGES))))
    return e.groupBy("symbol").agg(F.count("*").alias("total"), F.count_if(F.col("e") == 0).alias("valid"), F.count_if(F.col("e") > 0).alias("invalid"), F.sum("e").alias("errors"))


@query(
    "c04_typed_records",
    f"WITH {TICKS}, j AS (SELECT event_id, symbol, CASE WHEN event_id % 9 = 0 THEN '{{\"k\": ' ELSE props END AS body FROM ticks JOIN events USING (event_id, ts, user_id)), p AS (SELECT event_id, symbol, CASE WHEN json_valid(body) THEN CAST(json_extract_string(body, '$.k') AS INT) END AS k FROM j) SELECT event_id, CASE WHEN k IS NULL THEN 'malformed' WHEN symbol = 'purchase' AND k < 10 THEN 'too small' WHEN symbol = 'click' AND k > 90 THEN 'too large' ELSE 'ok' END AS verdict FROM p",
)
def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records checked by the rules of their type; a record that cannot be parsed is malformed, not an error."""
    e = table(spark, sf_dir, "events")
    body = F.when(F.col("event_id") % 9 == 0, '{"k": ').otherwise(F.col("props"))
    k = F.from_json(body, "k int, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    p = e.select("event_id", F.col("event_type").alias("symbol"), k.alias("p")).withColumn("k", F.when(F.col("p._corrupt").isNull(), F.col("p.k")))
    verdict = F.when(F.col("k").isNull(), "malformed").when((F.col("symbol") == "purchase") & (F.col("k") < 10), "too small").when((F.col("symbol") == "click") & (F.col("k") > 90), "too large").otherwise("ok")
    return p.select("event_id", verdict.alias("verdict"))


NY = "strftime(timezone('America/New_York', timezone('UTC', ts)), '%H:%M')"
SESSION_SQL = "CASE " + " ".join(f"WHEN {NY} >= '{a}' AND {NY} <= '{b}' THEN '{n}'" for n, a, b, _ in gates.SESSIONS) + " END"
GOOD_SQL = ", ".join(f"'{n}'" for n, _, _, good in gates.SESSIONS if good)


@query("c05_sessions", f"WITH {TICKS} SELECT event_id, {SESSION_SQL} AS session, coalesce({SESSION_SQL} IN ({GOOD_SQL}), false) AS tradeable FROM ticks")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("event_id", gates.session(F.col("ts")).alias("session"), gates.tradeable(F.col("ts")).alias("tradeable"))


@query("c06_regular_hours", f"WITH {TICKS} SELECT event_id, symbol FROM ticks WHERE {NY} >= '09:30' AND {NY} < '16:00'")
def regular_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where(gates.regular_hours(F.col("ts"))).select("event_id", "symbol")


@query("c07_market_hours", f"WITH {TICKS} SELECT symbol, count(*) AS n FROM ticks WHERE NOT (isodow(ts) = 6 OR (isodow(ts) = 7 AND hour(ts) < 21) OR (isodow(ts) = 5 AND hour(ts) >= 21)) GROUP BY 1")
def market_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where(gates.market_open(F.col("ts"))).groupBy("symbol").agg(F.count("*").alias("n"))


@query("c08_holidays", f"WITH {TICKS}, {MEETINGS} SELECT symbol, count(*) AS n FROM ticks WHERE isodow(ts) < 6 AND hour(ts) BETWEEN 8 AND 16 AND ts::DATE NOT IN (SELECT day FROM meet) GROUP BY 1")
def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working days and hours, without the days of a calendar table (some dates a year)."""
    from tapewright.plans.join_queries import meetings

    open_ = ticks(spark, sf_dir).where((F.weekday("ts") < 5) & F.hour("ts").between(8, 16)).withColumn("day", F.to_date("ts"))
    return open_.join(F.broadcast(meetings(spark)), "day", "left_anti").groupBy("symbol").agg(F.count("*").alias("n"))


TRADE_CHECKS = [("quantity", "quantity <= 45"), ("notional", "notional <= 80000"), ("risk", "r >= -3"), ("regime", "regime <> '5-LOW'")]


@query("c09_first_failed", f"WITH {TRADES} SELECT trade_id, line_no, notional, {'coalesce(' + ', '.join(f'CASE WHEN NOT ({c}) THEN {n!r} END' for n, c in TRADE_CHECKS)}) AS reason FROM trades")
def first_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [(n, F.expr(c)) for n, c in TRADE_CHECKS]
    return trades(spark, sf_dir).select("trade_id", "line_no", "notional", gates.first_failed(checks).alias("reason"))


GATE_NAMES = [
    ("confidence", "rsi / 100 >= 0.55"), ("direction", "z <> 0"), ("value", "z * (50 - rsi) < 0"), ("stop", "atr_pct BETWEEN 0.005 AND 2"), ("regime", "NOT (atr_pct > 1.5 AND stoch < 50)"),
    ("loss", "z > -2"), ("size", "close < 480"), ("hours", "hour(ts) BETWEEN 1 AND 22"), ("pattern", "stoch > 30"), ("agreement", "(z > 0) = (rsi > 50)"),
]


@query("c10_entry_gates", f"WITH {FEATURES}, c AS (SELECT symbol, bar_no, [{', '.join(f'coalesce({c}, false)' for _, c in GATE_NAMES)}] AS g, rsi FROM feats) SELECT symbol, bar_no, len(list_filter(g, lambda x: x)) AS passed, len(list_filter(g, lambda x: NOT x)) = 0 AS enter, coalesce(rsi / 100 >= 0.75, false) AND len(list_filter(g, lambda x: NOT x)) <= 1 AS override FROM c")
def entry_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates must pass; with high confidence one may fail."""
    g = F.array(*(F.struct(F.lit(n).alias("gate"), F.coalesce(F.expr(c), F.lit(False)).alias("ok")) for n, c in GATE_NAMES))
    f = features(spark, sf_dir).withColumn("g", g).withColumn("failed", F.size(F.filter("g", lambda x: ~x["ok"])))
    return f.select("symbol", "bar_no", (F.size("g") - F.col("failed")).alias("passed"), F.forall("g", lambda x: x["ok"]).alias("enter"), (F.coalesce(F.col("rsi") / 100 >= 0.75, F.lit(False)) & (F.col("failed") <= 1)).alias("override"))


WORKDAY = "isodow(ts) < 6"
VETOES = [("warm_up", "bar_no > 20"), ("volatility", "atr_pct < 1.2"), ("stretched", "abs(z) < 2"), ("session", "hour(ts) BETWEEN 6 AND 20"), ("weekend", None), ("momentum", "rsi BETWEEN 30 AND 70"), ("range", "stoch > 10")]


@query(
    "c11_veto_cascade",
    f"WITH {FEATURES}, v AS (SELECT *, coalesce({', '.join(f'CASE WHEN coalesce({c or WORKDAY}, false) THEN NULL ELSE {n!r} END' for n, c in VETOES)}) AS veto FROM feats) SELECT symbol, bar_no, veto, round(CASE WHEN veto IS NULL THEN CASE WHEN rsi > 50 THEN 1.25 ELSE 0.75 END * CASE WHEN atr_pct > 0.8 THEN 0.5 ELSE 1.0 END * least(greatest(1 - abs(z) / 4, 0.5), 1) ELSE 0 END, 6) AS size FROM v",
)
def veto_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered vetoes; rows that pass them all are sized by a product of factors."""
    checks = [(n, F.expr(c) if c else F.weekday("ts") < 5) for n, c in VETOES]
    factors = [F.when(F.col("rsi") > 50, 1.25).otherwise(0.75), F.when(F.col("atr_pct") > 0.8, 0.5).otherwise(1.0), F.least(F.greatest(1 - F.abs("z") / 4, F.lit(0.5)), F.lit(1.0))]
    return gates.cascade(features(spark, sf_dir), checks, factors).select("symbol", "bar_no", "veto", F.round("size", 6).alias("size"))


@query(
    "c12_guardrails",
    f"WITH {TRADES}, d AS (SELECT *, sum(pnl) OVER (PARTITION BY system, exit_ts::DATE ORDER BY {', '.join(IN_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS day_pnl FROM trades) SELECT trade_id, line_no, notional, CASE WHEN strategy = 'N' THEN 'kill_switch' WHEN notional > 90000 THEN 'size' WHEN coalesce(day_pnl, 0) < -5000 THEN 'daily_loss' END AS blocked FROM d",
)
def guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits from a control table, and the loss of the day so far."""
    w = W.partitionBy("system", F.to_date("exit_ts")).orderBy(*IN_ORDER).rowsBetween(W.unboundedPreceding, -1)
    control = F.broadcast(spark.createDataFrame([("N", True, 90000.0, -5000.0), ("A", False, 90000.0, -5000.0), ("R", False, 90000.0, -5000.0)], "strategy string, killed boolean, most double, loss double"))
    d = trades(spark, sf_dir).withColumn("day_pnl", F.coalesce(F.sum("pnl").over(w), F.lit(0.0))).join(control, "strategy", "left")
    blocked = F.when(F.col("killed"), "kill_switch").when(F.col("notional") > F.col("most"), "size").when(F.col("day_pnl") < F.col("loss"), "daily_loss")
    return d.select("trade_id", "line_no", "notional", blocked.alias("blocked"))


@query("c13_reversion_regime", f"WITH {FEATURES} SELECT symbol, bar_no, coalesce(atr_pct < 1 AND abs(z) < 1.5 AND rsi BETWEEN 35 AND 65, false) AS reversion FROM feats")
def reversion_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.expr("atr_pct < 1 AND abs(z) < 1.5 AND rsi BETWEEN 35 AND 65")
    return features(spark, sf_dir).select("symbol", "bar_no", F.coalesce(f, F.lit(False)).alias("reversion"))


@query(
    "c14_macro_gate",
    f"WITH {BARS}, {MACRO_AT}, j AS (SELECT b.*, m.value AS vix FROM bars b ASOF LEFT JOIN mac m ON b.ts >= m.ts), s AS (SELECT symbol, bar_no, sign(close - open) AS signal, close > {full('avg', 'close', 50)} AS bull, vix > 150000 AS high FROM j) SELECT symbol, bar_no, CASE WHEN coalesce(bull, false) AND coalesce(high, false) THEN 0 ELSE signal END AS signal FROM s",
)
def macro_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No signal while the trend is up and the macro value is high; an unknown trend is not up."""
    s = with_macro(spark, sf_dir).withColumn("bull", F.coalesce(F.col("close") > mean("close", 50), F.lit(False)))
    return s.select("symbol", "bar_no", F.when(F.col("bull") & F.coalesce(F.col("value") > 150_000, F.lit(False)), 0.0).otherwise(F.signum(F.col("close") - F.col("open"))).alias("signal"))


@query(
    "c15_term_structure_gate",
    f"WITH {BARS}, s AS (SELECT symbol, bar_no, sign(close - open) AS signal, close - {lag('close', 19)} AS a, close - {lag('close', 59)} AS b FROM bars) SELECT symbol, bar_no, CASE WHEN bar_no < 60 THEN signal WHEN a / 19 >= b / 59 THEN 0 ELSE signal END AS signal FROM s",
)
def term_structure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No signal where the short slope is at least the long one; without sixty bars the gate is open."""
    c = F.col("close")
    s = bars(spark, sf_dir).withColumn("a", (c - prev("close", 19)) / 19).withColumn("b", (c - prev("close", 59)) / 59)
    return s.select("symbol", "bar_no", F.when((F.col("bar_no") >= 60) & (F.col("a") >= F.col("b")), 0.0).otherwise(F.signum(c - F.col("open"))).alias("signal"))


@query("c16_crowding", f"WITH {FEATURES} SELECT symbol, bar_no, CASE WHEN abs(z) > 1.5 AND sign(z) = sign(rsi - 50) THEN 0.5 ELSE 1.0 END AS factor FROM feats")
def crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crowded = (F.abs("z") > 1.5) & (F.signum("z") == F.signum(F.col("rsi") - 50))
    return features(spark, sf_dir).select("symbol", "bar_no", F.when(crowded, 0.5).otherwise(1.0).alias("factor"))


@query("c17_blackout", f"WITH {BARS}, {MEETINGS} SELECT symbol, bar_no, coalesce(date_diff('day', ts::DATE, (SELECT min(day) FROM meet WHERE day >= ts::DATE)) BETWEEN 0 AND 10, false) AS blackout FROM bars")
def blackout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.plans.join_queries import next_event

    return next_event(spark, sf_dir).select("symbol", "bar_no", F.col("days_to_next").between(0, 10).alias("blackout"))


@query("c18_correlation_cap")
def correlation_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two open trades of a customer's orders; later ones are refused until one has closed."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("entry"), F.expr("o_orderdate + make_interval(0, 0, 0, cast(30 + o_orderkey % 60 as int))").alias("exit"))
    return matching.capped_open(o, "o_custkey", "entry", "exit", ["entry", "o_orderkey"], 2)


@query("c19_rule_expression", f"WITH {TRADES} SELECT count(*) FILTER (quantity > 20 AND regime IN ('1-URGENT', '2-HIGH') AND NOT r < 0) AS kept, count(*) AS n FROM trades")
def rule_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return t.agg(F.count_if(gates.rule(t, "quantity > 20 and regime in ('1-URGENT', '2-HIGH') and not r < 0")).alias("kept"), F.count("*").alias("n"))


@query(
    "c20_event_risk",
    f"WITH {TICKS}, g AS (SELECT ts::DATE AS day, count(*) FILTER (price > 150) AS n, bool_or(symbol = 'purchase' AND price > 300) AS hot FROM ticks GROUP BY 1) SELECT day, CASE WHEN n = 0 THEN 'CLEAR' WHEN hot THEN 'EXTREME' WHEN n >= 3 THEN 'HIGH' ELSE 'ELEVATED' END AS level FROM g",
)
def event_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ticks(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("price") > 150).alias("n"), F.bool_or((F.col("symbol") == "purchase") & (F.col("price") > 300)).alias("hot"))
    return g.select("day", F.when(F.col("n") == 0, "CLEAR").when(F.col("hot"), "EXTREME").when(F.col("n") >= 3, "HIGH").otherwise("ELEVATED").alias("level"))


@query("c21_real_fills", f"WITH {TRADES} SELECT strategy, count(*) AS n FROM trades WHERE NOT (coalesce(system, '') = 'F' OR coalesce(regime, '') LIKE '4%') GROUP BY 1")
def real_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated and unfilled records out; a record of unknown kind stays."""
    simulated = F.coalesce("system", F.lit("")) == "F"
    unfilled = F.coalesce("regime", F.lit("")).startswith("4")
    return trades(spark, sf_dir).where(~(simulated | unfilled)).groupBy("strategy").agg(F.count("*").alias("n"))

"""Scans, ledgers, sinks and column normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators import matching
from tapewright.plans.registry import Registry
from tapewright.plans.sql import BARS, MACRO, TICKS, TRADES
from tapewright.sources import ledgers
from tapewright.sources.market import bars, macro_daily, table, ticks, trades
from tapewright.sources.staging import scratch

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("a01_cached_bars", f"WITH {TICKS}, m AS (SELECT symbol, date_trunc('minute', ts) AS ts, arg_max(price, (ts, event_id)) AS price FROM ticks WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1, 2) SELECT * FROM m")
def cached_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of time, one row for each symbol and minute: the last one written wins."""
    t = ticks(spark, sf_dir).where("ts >= timestamp_ntz '2024-01-05 00:00:00' and ts < timestamp_ntz '2024-01-12 00:00:00'")
    t = t.withColumn("at", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return matching.latest(t, ["symbol", "at"], ["ts", "event_id"]).select("symbol", F.col("at").alias("ts"), "price")


@query("a02_universe", f"WITH {BARS} SELECT symbol, ts, close FROM bars WHERE symbol IN ('click', 'purchase', 'nothing')")
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).where(F.col("symbol").isin("click", "purchase", "nothing")).select("symbol", "ts", "close")


@query("a03_bar_counts", f"WITH {BARS} SELECT symbol, count(*) AS n, min(ts) AS first, max(ts) AS last, count(*) >= 8000 AS sufficient FROM bars GROUP BY 1")
def bar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), (F.count("*") >= 8000).alias("sufficient"))


@query("a07_one_day", f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).where("ts >= timestamp_ntz '2024-01-10 00:00:00' and ts < timestamp_ntz '2024-01-11 00:00:00'").select("symbol", "ts", "open", "high", "low", "close", "volume")


@query("a10_fallback", f"WITH {BARS} SELECT symbol, ts, close, CASE WHEN bar_no % 3 <> 0 THEN 'primary' ELSE 'fallback' END AS provider FROM bars")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    first = b.where("bar_no % 3 <> 0").select("symbol", "ts", "close", F.lit("primary").alias("provider"))
    return ledgers.prefer(first, b.select("symbol", "ts", "close", F.lit("fallback").alias("provider")), ["symbol", "ts"])


@query(
    "a11_business_days",
    f"WITH {MACRO}, c AS (SELECT unnest(generate_series(DATE '2023-12-01', DATE '2024-02-15', INTERVAL 1 DAY))::DATE AS day), s AS (SELECT * FROM macro WHERE value > 140000) SELECT c.day, round(s.value, 6) AS value FROM c ASOF LEFT JOIN s ON c.day >= s.day WHERE isodow(c.day) < 6",
)
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series on business days, carried forward and never interpolated."""
    from tapewright.operators.asof import asof_by_day

    days = spark.sql("SELECT explode(sequence(DATE '2023-12-01', DATE '2024-02-15')) AS day0").where(F.weekday("day0") < 5)
    out = asof_by_day(days, macro_daily(spark, sf_dir).where("value > 140000"), "day0", "day", ["value"])
    return out.select(F.col("day0").alias("day"), F.round("value", 6).alias("value"))


@query("a12_country_macro", "WITH m AS (SELECT n_name, avg(c_acctbal) AS rate FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) SELECT b.n_name AS base, q.n_name AS quote, round(coalesce(b.rate, 0) - coalesce(q.rate, 0), 6) AS diff FROM m b JOIN m q ON b.n_name < q.n_name")
def country_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate differences of currency pairs; countries are a dimension, and its pairs the result."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("rate"))
    m = table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select("n_name", F.coalesce("rate", F.lit(0.0)).alias("rate"))
    q = m.select(F.col("n_name").alias("quote"), F.col("rate").alias("other"))
    return m.join(F.broadcast(q), F.col("n_name") < F.col("quote")).select(F.col("n_name").alias("base"), "quote", F.round(F.col("rate") - F.col("other"), 6).alias("diff"))


@query("a13_net_positions", "SELECT l_linestatus AS market, date_trunc('week', l_shipdate)::DATE AS week, sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) AS net FROM lineitem GROUP BY ALL")
def net_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(0.0)
    return line.groupBy(F.col("l_linestatus").alias("market"), F.date_trunc("week", "l_shipdate").cast("date").alias("week")).agg(F.sum(side).alias("net"))


@query("a14_json_ledger", f"WITH {TICKS} SELECT event_id, symbol, price FROM ticks WHERE ts >= TIMESTAMP '2024-01-20' AND event_id % 50 <> 0")
def json_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of JSON lines, some of them damaged, read back with a cut-off in time."""
    t = ticks(spark, sf_dir)
    line = F.to_json(F.struct("event_id", "symbol", "price", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")))
    path = scratch(spark, "ledger")
    t.select(F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    back = ledgers.read_jsonl(spark, path, "event_id long, symbol string, price double, at string")
    return back.where("at >= '2024-01-20'").select("event_id", "symbol", "price")


@query("a15_csv_ledger", f"WITH {TRADES} SELECT trade_id, line_no, strategy, pnl, CAST(NULL AS DOUBLE) AS mae FROM trades")
def csv_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ledger")
    trades(spark, sf_dir).select("trade_id", "line_no", "strategy", "pnl").write.option("header", True).csv(path)
    return ledgers.read_csv(spark, path, "trade_id string, line_no int, strategy string, pnl double, mae double", ["trade_id", "pnl"])


@query("a16_present_columns", f"WITH {TRADES} SELECT trade_id, line_no, strategy, pnl, r FROM trades")
def present_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.present(trades(spark, sf_dir), ["trade_id", "line_no", "hurst", "strategy", "pnl", "vol_pct", "r"])


@query("a17_append_new", f"WITH {TRADES}, k AS (SELECT strategy, regime, md5(concat_ws('|', strategy, regime, CAST(quantity AS INT))) AS trade_key, CAST(quantity AS INT) AS lot, year(exit_ts) AS y FROM trades), n AS (SELECT DISTINCT strategy, regime, lot, trade_key FROM k WHERE y >= 1998) SELECT * FROM n WHERE trade_key NOT IN (SELECT trade_key FROM k WHERE y < 1998)")
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    k = trades(spark, sf_dir).select("strategy", "regime", F.col("quantity").cast("int").alias("lot"), F.year("exit_ts").alias("y"))
    stored = k.where("y < 1998").withColumn("trade_key", F.md5(F.concat_ws("|", "strategy", "regime", F.col("lot").cast("string")))).select("trade_key").distinct()
    return matching.append_new(stored, k.where("y >= 1998").drop("y"), ["strategy", "regime", "lot"])


@query("a18_upsert_probe", f"WITH {TRADES}, s AS (SELECT regime, count(*) AS n, sum(pnl) AS total FROM trades WHERE year(exit_ts) < 1998 GROUP BY 1), u AS (SELECT regime, count(*) AS n, sum(pnl) AS total FROM trades WHERE year(exit_ts) >= 1998 AND regime <> '5-LOW' GROUP BY 1), a AS (SELECT * FROM u UNION ALL SELECT * FROM s WHERE regime NOT IN (SELECT regime FROM u)) SELECT regime, n, round(total, 4) AS total FROM a")
def upsert_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    state = lambda x: x.groupBy("regime").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("total"))
    return matching.upsert(state(t.where("year(exit_ts) < 1998")), state(t.where("year(exit_ts) >= 1998 and regime <> '5-LOW'")), ["regime"])


@query("a19_parquet_sink", f"WITH {BARS} SELECT symbol, ts, close, volume FROM bars WHERE symbol = 'view'")
def parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by symbol, so that a later scan of one symbol reads its folder only."""
    path = scratch(spark, "bars")
    bars(spark, sf_dir).select("symbol", "ts", "close", "volume").write.option("compression", "snappy").partitionBy("symbol").parquet(path)
    return spark.read.parquet(path).where("symbol = 'view'").select("symbol", "ts", "close", "volume")


@query("a20_report_sinks", f"WITH {TRADES} SELECT regime, count(*) AS n, round(sum(pnl), 4) AS total FROM trades GROUP BY 1")
def report_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "report")
    trades(spark, sf_dir).groupBy("regime").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("total")).write.json(path)
    return spark.read.schema("regime string, n long, total double").json(path)


@query(
    "a21_label_first",
    f"WITH {TICKS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, symbol ORDER BY ts, event_id) AS k FROM ticks), u AS (SELECT DISTINCT user_id, symbol FROM ticks WHERE price > 200) SELECT event_id, CASE WHEN k = 1 AND u.user_id IS NOT NULL THEN 'TP1' END AS outcome FROM k LEFT JOIN u USING (user_id, symbol)",
)
def label_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("outcome", F.lit(None).cast("string"))
    updates = t.where("price > 200").select("user_id", "symbol").distinct().withColumn("outcome", F.lit("TP1"))
    return ledgers.label_first(t, updates, ["user_id", "symbol"], ["ts", "event_id"], ["outcome"]).select("event_id", "outcome")


@query("a23_headlines", "SELECT doc_id, lang, source, split_part(text, chr(10), 1) AS headline FROM documents WHERE text IS NOT NULL")
def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every document, whole, with where it comes from."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", "lang", "source", F.substring_index("text", "\n", 1).alias("headline"))


@query("a23_all_headlines", "SELECT doc_id, lang, split_part(text, chr(10), 1) AS headline FROM documents WHERE text IS NOT NULL")
def all_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", "lang", F.substring_index("text", "\n", 1).alias("headline"))


@query("a25_replay", f"WITH {BARS}, p AS (SELECT symbol, bar_no, avg(close) OVER w AS mean, max(high) OVER w AS top FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT symbol, bar_no, round(mean, 6) AS mean, top FROM p WHERE bar_no > 20")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replay knows at each bar after its warm-up: all bars so far."""
    w = W.partitionBy("symbol").orderBy("bar_no").rowsBetween(W.unboundedPreceding, 0)
    return bars(spark, sf_dir).select("symbol", "bar_no", F.round(F.avg("close").over(w), 6).alias("mean"), F.max("high").over(w).alias("top")).where("bar_no > 20")


@query("b01_lower_columns", f"WITH {BARS} SELECT symbol, ts, open, high, low, close FROM bars")
def lower_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = bars(spark, sf_dir).select("symbol", "ts", "open", "high", "low", "close").toDF("Symbol", "TS", "Open", "HIGH", "Low", "Close")
    return ledgers.lower_columns(upper)


@query("b02_complete_bars", f"WITH {BARS} SELECT symbol, bar_no, open, high, low, close FROM bars WHERE bar_no % 5 <> 0")
def complete_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("low", F.when(F.col("bar_no") % 5 != 0, F.col("low")))
    return b.select("symbol", "bar_no", "open", "high", "low", "close").dropna()


KINDS = ["%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M", "%Y-%m-%d", "on %d"]


@query(
    "b05_canonical_time",
    f"WITH {TICKS}, s AS (SELECT event_id, {'CASE event_id % 5 ' + ' '.join(f'WHEN {i} THEN strftime(ts, {k!r})' for i, k in enumerate(KINDS))} END AS raw FROM ticks) SELECT event_id, coalesce(strftime(try_strptime(raw, {KINDS[:4]}), '%Y-%m-%d %H:%M:%S'), raw) AS at FROM s",
)
def canonical_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy-MM-dd", "'on' dd"]
    raw = F.lit(None)
    for i, k in enumerate(kinds):
        raw = F.when(F.col("event_id") % 5 == i, F.date_format("ts", k)).otherwise(raw)
    return ticks(spark, sf_dir).select("event_id", ledgers.canonical_time(raw).alias("at"))


@query("b06_same_time", f"WITH {TICKS}, s AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, CASE WHEN event_id % 2 = 0 THEN strftime(ts + INTERVAL 40 MINUTE, '%Y-%m-%d') ELSE strftime(ts + INTERVAL 40 MINUTE, '%Y-%m-%d %H:%M:%S') END AS b FROM ticks) SELECT event_id, CASE WHEN length(a) <= 10 OR length(b) <= 10 THEN left(a, 10) = left(b, 10) ELSE left(a, 13) = left(b, 13) END AS same FROM s")
def same_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.expr("ts + interval 40 minutes")
    b = F.when(F.col("event_id") % 2 == 0, F.date_format(later, "yyyy-MM-dd")).otherwise(F.date_format(later, "yyyy-MM-dd HH:mm:ss"))
    s = ticks(spark, sf_dir).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("a"), b.alias("b"))
    return s.select("event_id", ledgers.same_time(F.col("a"), F.col("b")).alias("same"))


@query("b07_encoding", f"WITH {TRADES} SELECT trade_id, line_no, notional, CASE system WHEN 'O' THEN 1 WHEN 'F' THEN -1 ELSE 0 END AS direction, CAST(left(regime, 1) AS INT) AS grade, (strategy = 'A')::INT AS is_a, (strategy = 'R')::INT AS is_r, round(CASE system WHEN 'O' THEN 1 WHEN 'F' THEN -1 ELSE 0 END * r, 6) AS r_by_direction FROM trades")
def encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("system") == "O", 1).when(F.col("system") == "F", -1).otherwise(0)
    flag = lambda s: (F.col("strategy") == s).cast("int")
    return trades(spark, sf_dir).select("trade_id", "line_no", "notional", d.alias("direction"), F.left("regime", F.lit(1)).cast("int").alias("grade"), flag("A").alias("is_a"), flag("R").alias("is_r"), F.round(d * F.col("r"), 6).alias("r_by_direction"))


@query("b08_r_multiple", f"WITH {BARS}, x AS (SELECT symbol, bar_no, close AS entry, low AS stop, lead(close, 3) OVER (PARTITION BY symbol ORDER BY bar_no) AS later FROM bars) SELECT symbol, bar_no, CASE WHEN abs(entry - stop) = 0 THEN 0 ELSE round((later - entry) / abs(entry - stop), 3) END AS r FROM x")
def r_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.operators.scalars import r_multiple as r

    later = F.lead("close", 3).over(W.partitionBy("symbol").orderBy("bar_no"))
    x = bars(spark, sf_dir).select("symbol", "bar_no", F.col("close").alias("entry"), F.col("low").alias("stop"), later.alias("later"))
    return x.select("symbol", "bar_no", r(F.col("entry"), F.col("stop"), F.col("later"), F.lit(1)).alias("r"))


@query("b09_trade_value", f"WITH {TRADES}, k(strategy, point, cost) AS (VALUES ('A', 5.0, 4.5), ('N', 2.0, 1.2)) SELECT trade_id, line_no, notional, round(r * point * quantity - cost * quantity, 6) AS usd FROM trades LEFT JOIN k USING (strategy)")
def trade_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points times the contract's value less its round-turn cost; null for contracts that are not listed."""
    k = F.broadcast(spark.createDataFrame([("A", 5.0, 4.5), ("N", 2.0, 1.2)], "strategy string, point double, cost double"))
    j = trades(spark, sf_dir).join(k, "strategy", "left")
    return j.select("trade_id", "line_no", "notional", F.round(F.col("r") * F.col("point") * F.col("quantity") - F.col("cost") * F.col("quantity"), 6).alias("usd"))

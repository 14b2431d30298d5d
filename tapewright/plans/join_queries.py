"""As-of, event, interval, membership and set joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators import asof, matching
from tapewright.plans.registry import Registry
from tapewright.plans.sql import BARS, MACRO, TICKS, TRADES
from tapewright.sources.market import IN_ORDER, bars, macro_daily, table, ticks, trades

query = Registry()
QUERIES, SQL = query.queries, query.sql
ORDER_SQL = ", ".join(IN_ORDER)


def macro_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_daily(spark, sf_dir).select(F.col("day").cast("timestamp_ntz").alias("ts"), "value")


MACRO_AT = f"{MACRO}, mac AS (SELECT day::TIMESTAMP AS ts, value FROM macro)"


@query("d01_asof", f"WITH {BARS}, {MACRO_AT} SELECT symbol, bar_no, round(m.value, 6) AS macro FROM bars b ASOF LEFT JOIN mac m ON b.ts >= m.ts")
def asof_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The macro value at each bar. A daily series (a row a day, checked) goes to every task; beyond that, to every day's bars."""
    return with_macro(spark, sf_dir).select("symbol", "bar_no", F.round("value", 6).alias("macro"))


def with_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with ``value``: the series is carried forward to every calendar day, so that the join is by day."""
    return asof.asof_by_day(bars(spark, sf_dir), macro_daily(spark, sf_dir), "ts", "day", ["value"])


@query(
    "d01_asof_by_symbol",
    f"WITH {BARS}, {TICKS}, big AS (SELECT symbol, ts, max(price) AS seen FROM ticks WHERE price > 100 GROUP BY ALL) SELECT b.symbol, bar_no, g.seen FROM bars b ASOF LEFT JOIN big g ON b.symbol = g.symbol AND b.ts >= g.ts".replace(f"{TICKS}, big", "big"),
)
def asof_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = ticks(spark, sf_dir).where("price > 100").groupBy("symbol", "ts").agg(F.max("price").alias("seen"))
    return asof.asof_join(bars(spark, sf_dir).select("symbol", "ts", "bar_no"), big, "ts", ["seen"], ["symbol"]).select("symbol", "bar_no", "seen")


@query("d02_asof_fallback", f"WITH {BARS}, {MACRO_AT}, late AS (SELECT * FROM mac WHERE ts >= TIMESTAMP '2024-01-10' AND value > 150000) SELECT symbol, bar_no, round(coalesce(m.value, -1), 6) AS macro FROM bars b ASOF LEFT JOIN late m ON b.ts >= m.ts")
def asof_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = macro_daily(spark, sf_dir).where("day >= '2024-01-10' and value > 150000")
    out = asof.asof_by_day(bars(spark, sf_dir), late, "ts", "day", ["value"])
    return out.select("symbol", "bar_no", F.round(F.coalesce("value", F.lit(-1.0)), 6).alias("macro"))


MEETINGS = "meet AS (SELECT unnest([DATE '2024-01-05', DATE '2024-01-16', DATE '2024-01-25']) AS day)"


def meetings(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT explode(array(DATE '2024-01-05', DATE '2024-01-16', DATE '2024-01-25')) AS day")


@query("d03_next_event", f"WITH {BARS}, {MEETINGS} SELECT symbol, bar_no, coalesce(date_diff('day', ts::DATE, (SELECT min(day) FROM meet WHERE day >= ts::DATE)), 999) AS days_to_next, coalesce(date_diff('day', (SELECT max(day) FROM meet WHERE day < ts::DATE), ts::DATE), 999) AS days_since_last FROM bars")
def next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to the next meeting and since the last; meetings are one sorted list in each row's search."""
    days = F.broadcast(meetings(spark).agg(F.sort_array(F.collect_list("day")).alias("days")))  # a calendar: some dates a year
    b = bars(spark, sf_dir).withColumn("d", F.to_date("ts")).join(days)
    after, before = F.array_min(F.filter("days", lambda x: x >= F.col("d"))), F.array_max(F.filter("days", lambda x: x < F.col("d")))
    return b.select("symbol", "bar_no", F.coalesce(F.datediff(after, "d"), F.lit(999)).alias("days_to_next"), F.coalesce(F.datediff("d", before), F.lit(999)).alias("days_since_last"))


@query(
    "d04_event_alignment",
    f"WITH {BARS}, {TICKS}, e AS (SELECT symbol, event_id, ts, price FROM ticks WHERE price > 200) SELECT e.symbol, e.event_id, b.bar_no FROM e ASOF LEFT JOIN bars b ON e.symbol = b.symbol AND e.ts <= b.ts".replace(f"{TICKS}, e AS", "e AS"),
)
def event_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each large tick with the first bar that starts at or after it."""
    e = ticks(spark, sf_dir).where("price > 200").select("symbol", "event_id", "ts")
    return asof.asof_join(e, bars(spark, sf_dir).select("symbol", "ts", "bar_no"), "ts", ["bar_no"], ["symbol"], forward=True).select("symbol", "event_id", "bar_no")


@query(
    "d04_priority_overlay",
    f"""WITH {BARS}, {TICKS}, e AS (SELECT symbol, date_trunc('hour', ts) AS ts, CASE WHEN price > 200 THEN 3 WHEN price > 100 THEN 2 ELSE 1 END AS priority, sign(size - 50)::INT AS signal, event_id FROM ticks)
    SELECT symbol, ts, arg_max(signal, (priority, event_id)) AS signal, max(priority) AS priority FROM e GROUP BY ALL""".replace(f"{BARS}, ", ""),
)
def priority_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the events of a bar the one of highest priority (then the latest) gives the signal."""
    priority = F.when(F.col("price") > 200, 3).when(F.col("price") > 100, 2).otherwise(1)
    e = ticks(spark, sf_dir).select("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), priority.alias("priority"), F.signum(F.col("size") - 50).cast("int").alias("signal"), "event_id")
    return e.groupBy("symbol", "ts").agg(F.max_by("signal", F.struct("priority", "event_id")).alias("signal"), F.max("priority").alias("priority"))


def two(sf: str = "") -> str:
    return f"WITH {BARS}, x AS (SELECT ts, close AS a FROM bars WHERE symbol = 'click'), y AS (SELECT ts, close AS b FROM bars WHERE symbol = 'purchase')"


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = bars(spark, sf_dir)
    return tuple(b.where(F.col("symbol") == s).select("ts", F.col("close").alias(c)) for s, c in (("click", "a"), ("purchase", "b")))


@query("d05_common_dates", f"{two()} SELECT ts, round(a - b, 6) AS diff FROM x JOIN y USING (ts)")
def common_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = pair(spark, sf_dir)
    return x.join(y, "ts").select("ts", F.round(F.col("a") - F.col("b"), 6).alias("diff"))


@query("d06_inner_on_index", f"WITH {TRADES}, m AS (SELECT o_orderdate::DATE AS day, avg(o_totalprice) AS market FROM orders GROUP BY 1) SELECT t.trade_id, t.line_no, t.pnl, round(market, 6) AS market FROM trades t JOIN m ON t.exit_ts::DATE = m.day")
def inner_on_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("market"))
    t = trades(spark, sf_dir).withColumn("day", F.to_date("exit_ts"))
    return t.join(m, "day").select("trade_id", "line_no", "pnl", F.round("market", 6).alias("market"))


@query("d07_signals_trades", "SELECT c_mktsegment AS segment, count(*) AS signals, count(o_orderkey) AS filled, round(sum(o_totalprice), 4) AS value FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1")
def signals_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_totalprice")
    j = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("signals"), F.count("o_orderkey").alias("filled"), F.round(F.sum("o_totalprice"), 4).alias("value"))


@query("d08_reindex", f"WITH {BARS}, k AS (SELECT ts, avg(close) AS bench FROM bars GROUP BY 1) SELECT symbol, bar_no, round(close / bench, 6) AS relative FROM bars LEFT JOIN k USING (ts)")
def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars beside the mean of all symbols at the same time, by a window: one shuffle, no join."""
    return bars(spark, sf_dir).select("symbol", "bar_no", F.round(F.col("close") / F.avg("close").over(W.partitionBy("ts")), 6).alias("relative"))


@query("d09_fill_enrichment", "SELECT o_orderkey AS order_id, count(l_orderkey) AS fills, round(sum(l_extendedprice), 4) AS filled, count(*) FILTER (l_tax <= 0.5 * l_discount) AS sane FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def fill_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills are summed by order before the join."""
    fills = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("v"), F.count_if(F.col("l_tax") <= 0.5 * F.col("l_discount")).alias("s"))
    j = table(spark, sf_dir, "orders").join(fills, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select(F.col("o_orderkey").alias("order_id"), F.coalesce("n", F.lit(0)).alias("fills"), F.round("v", 4).alias("filled"), F.coalesce("s", F.lit(0)).alias("sane"))


@query(
    "d10_overlap_weights",
    f"WITH {BARS}, e AS (SELECT symbol, bar_no, bar_no + CASE WHEN close > open THEN 5 ELSE 3 END AS until FROM bars), c AS (SELECT a.symbol, a.bar_no, count(*) AS n_overlaps FROM e a JOIN e b ON a.symbol = b.symbol AND a.bar_no <= b.until AND b.bar_no <= a.until GROUP BY ALL) SELECT symbol, bar_no, n_overlaps, round(1.0 / n_overlaps / sum(1.0 / n_overlaps) OVER (PARTITION BY symbol) * count(*) OVER (PARTITION BY symbol), 6) AS weight FROM c",
)
def overlap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many label spans overlap each one, counted by a sweep, and weights that sum to the number of rows."""
    e = bars(spark, sf_dir).select("symbol", "bar_no", (F.col("bar_no") + F.when(F.col("close") > F.col("open"), 5).otherwise(3)).alias("until"))
    c = asof.overlap_counts(e, ["symbol"], "bar_no", "until")
    w = W.partitionBy("symbol")
    return c.select("symbol", "bar_no", "n_overlaps", F.round(1 / F.col("n_overlaps") / F.sum(1 / F.col("n_overlaps")).over(w) * F.count("*").over(w), 6).alias("weight"))


@query(
    "d11_post_entry_window",
    f"WITH {BARS}, e AS (SELECT symbol, bar_no AS entry, close AS price FROM bars WHERE bar_no % 25 = 0) SELECT e.symbol, e.entry, count(*) AS n, max(high) AS best, min(low) AS worst FROM e JOIN bars b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.entry AND e.entry + 12 GROUP BY ALL",
)
def post_entry_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    e = b.where("bar_no % 25 = 0").select("symbol", F.col("bar_no").alias("entry"))
    return asof.window_join(e, b.select("symbol", "bar_no", "high", "low"), ["symbol"], "entry", 12, [F.count("*").alias("n"), F.max("high").alias("best"), F.min("low").alias("worst")])


TOK = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 3))"


@query(
    "d12_skip_similar",
    f"""WITH b AS (SELECT item_id, text, item_id % 2 AS subsystem FROM benchmark), c AS (SELECT item_id, subsystem, {TOK} AS w FROM b WHERE item_id % 4 < 2), r AS (SELECT subsystem, {TOK} AS w FROM b WHERE item_id % 4 >= 2),
    j AS (SELECT item_id, max(CASE WHEN len(c.w) > 0 THEN len(list_intersect(c.w, r.w)) / len(c.w) ELSE 0 END) AS o FROM c JOIN r USING (subsystem) GROUP BY 1) SELECT item_id, round(coalesce(o, 0), 6) AS overlap, coalesce(o, 0) > 0.3 AS skip FROM c LEFT JOIN j USING (item_id)""",
)
def skip_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("subsystem", F.col("item_id") % 2)
    out = matching.covered_by(b.where("item_id % 4 < 2"), b.where("item_id % 4 >= 2"), "item_id", "text", ["subsystem"], 0.3)
    return out.select("item_id", "overlap", "skip")


@query("d13_parameter_grid", "SELECT stop, target, period, symbol FROM (SELECT unnest([1.0, 1.5, 2.0]) AS stop) CROSS JOIN (SELECT unnest([1.0, 2.0, 3.0]) AS target) CROSS JOIN (SELECT unnest([10, 14]) AS period) CROSS JOIN (SELECT DISTINCT event_type AS symbol FROM events) WHERE target >= stop")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters are one array in each symbol's row; symbols times parameters are the result itself."""
    lists = {"stop": [1.0, 1.5, 2.0], "target": [1.0, 2.0, 3.0], "period": [10, 14]}
    out = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.where("target >= stop").select("stop", "target", "period", "symbol")


SECTORS = {"click": "attention", "view": "attention", "purchase": "revenue"}


@query("d14_sector", f"WITH {BARS}, s(symbol, sector) AS (VALUES {', '.join(map(str, SECTORS.items()))}) SELECT coalesce(sector, 'UNKNOWN') AS sector, count(*) AS bars, sum(volume) AS volume FROM bars LEFT JOIN s USING (symbol) GROUP BY 1")
def sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = F.create_map(*(F.lit(x) for p in SECTORS.items() for x in p))
    return bars(spark, sf_dir).groupBy(F.coalesce(F.try_element_at(sectors, F.col("symbol")), F.lit("UNKNOWN")).alias("sector")).agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"))


GATE_SQL = "WITH v AS (SELECT o_orderdate::DATE AS day, o_orderpriority AS gate FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT DISTINCT day, gate FROM v)"


def vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("gate"))


@query("d15_gate_pairs", f"{GATE_SQL} SELECT x.gate AS a, y.gate AS b, count(*) AS n FROM s x JOIN s y ON x.day = y.day AND x.gate < y.gate GROUP BY ALL")
def gate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.co_occurrence(vetoes(spark, sf_dir), "day", "gate")[0]


@query("d15_gate_solo", f"{GATE_SQL}, c AS (SELECT gate, count(*) OVER (PARTITION BY day) AS k FROM s) SELECT gate AS item, count(*) AS fires, count(*) FILTER (k = 1) AS solo_fires, count(*) FILTER (k = 1) / count(*) < 0.05 AS redundant FROM c GROUP BY 1")
def gate_solo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.co_occurrence(vetoes(spark, sf_dir), "day", "gate")[1].withColumn("redundant", F.col("solo_fires") / F.col("fires") < 0.05)


@query(
    "d16_open_positions",
    f"WITH {TICKS}, e AS (SELECT user_id, CASE WHEN symbol = 'purchase' THEN 'ENTRY' WHEN symbol IN ('click', 'view') THEN 'CLOSE' END AS kind, ts, event_id FROM ticks), r AS (SELECT * FROM e WHERE kind IS NOT NULL), l AS (SELECT user_id, arg_max(kind, (ts, event_id)) AS k, max(ts) FILTER (kind = 'ENTRY') AS opened_at FROM r GROUP BY 1) SELECT user_id, opened_at FROM l WHERE k = 'ENTRY'",
)
def open_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("symbol") == "purchase", "ENTRY").when(F.col("symbol").isin("click", "view"), "CLOSE")
    e = ticks(spark, sf_dir).withColumn("kind", kind)
    return matching.still_open(e, "user_id", "kind", ["ts", "event_id"], "ENTRY", ["CLOSE"]).select("user_id", F.col("opened.ts").alias("opened_at"))


@query("d17_new_candidates", "SELECT stop, target FROM (SELECT unnest([1.0, 1.5, 2.0, 2.5]) AS stop) CROSS JOIN (SELECT unnest([1.0, 2.0, 3.0]) AS target) EXCEPT SELECT l_discount * 0 + 1.0 AS stop, floor(l_quantity / 20) + 1.0 AS target FROM lineitem")
def new_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, [1.0, 1.5, 2.0, 2.5]))).alias("stop")).withColumn("target", F.explode(F.array(*map(F.lit, [1.0, 2.0, 3.0]))))
    queued = table(spark, sf_dir, "lineitem").select(F.lit(1.0).alias("stop"), (F.floor(F.col("l_quantity") / 20) + 1.0).alias("target")).distinct()
    return grid.join(queued, ["stop", "target"], "left_anti")


@query(
    "d18_lessons",
    f"""WITH {TRADES}, u AS (SELECT unnest([regime, strategy]) AS lesson, pnl > 0 AS win, year(exit_ts) >= 1998 AS recent FROM trades), g AS (SELECT lesson, count(*) AS n, avg(win::INT) FILTER (NOT recent) AS base, avg(win::INT) FILTER (recent) AS now FROM u GROUP BY 1)
    SELECT lesson, n, CASE WHEN n < 50 OR base IS NULL OR now IS NULL THEN 'INSUFFICIENT' WHEN base - now > 0.1 THEN 'DEAD' WHEN base - now > 0.03 THEN 'FADING' ELSE 'ALIVE' END AS status FROM g""",
)
def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons are a list in each trade; each is judged by the trades that carried it."""
    t = trades(spark, sf_dir).withColumn("lessons", F.array("regime", "strategy")).withColumn("recent", F.year("exit_ts") >= 1998)
    u = t.select(F.explode("lessons").alias("lesson"), (F.col("pnl") > 0).cast("int").alias("win"), "recent")
    g = u.groupBy("lesson").agg(F.count("*").alias("n"), F.avg(F.when(~F.col("recent"), F.col("win"))).alias("base"), F.avg(F.when(F.col("recent"), F.col("win"))).alias("now"))
    drop = F.col("base") - F.col("now")
    return g.select("lesson", "n", F.when((F.col("n") < 50) | drop.isNull(), "INSUFFICIENT").when(drop > 0.1, "DEAD").when(drop > 0.03, "FADING").otherwise("ALIVE").alias("status"))


PEERS = [("click", "view"), ("click", "purchase"), ("view", "click"), ("purchase", "click"), ("purchase", "view")]


@query(
    "d19_peer_alignment",
    f"""WITH {BARS}, p(symbol, peer) AS (VALUES {', '.join(map(str, PEERS))}), d AS (SELECT symbol, ts, bar_no, sign(close - open) AS dir FROM bars),
    j AS (SELECT d.symbol, d.bar_no, d.dir, o.dir AS other FROM d JOIN p USING (symbol) LEFT JOIN d o ON o.symbol = p.peer AND o.ts = d.ts)
    SELECT symbol, bar_no, round(coalesce(avg((dir = other)::INT) * 0.25, 0.125), 6) AS score FROM j GROUP BY ALL""",
)
def peer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a symbol's peers whose bar at the same time points the same way, times a quarter; an eighth without any."""
    d = bars(spark, sf_dir).select("symbol", "ts", "bar_no", F.signum(F.col("close") - F.col("open")).alias("dir"))
    peers = F.broadcast(spark.createDataFrame(PEERS, "symbol string, peer string"))
    other = d.select(F.col("symbol").alias("peer"), "ts", F.col("dir").alias("other"))
    j = d.join(peers, "symbol").join(other, ["peer", "ts"], "left")
    return j.groupBy("symbol", "bar_no").agg(F.round(F.coalesce(F.avg((F.col("dir") == F.col("other")).cast("int")) * 0.25, F.lit(0.125)), 6).alias("score"))


# --- top rows and sets


@query("g01_sorted_metric", f"WITH {TRADES}, g AS (SELECT strategy, system, regime, count(*) AS n, avg(r) AS mean FROM trades GROUP BY ALL HAVING count(*) >= 20) SELECT strategy, system, regime, n, round(mean, 6) AS mean, row_number() OVER (ORDER BY mean DESC, strategy, system, regime) AS place FROM g")
def sorted_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trades(spark, sf_dir).groupBy("strategy", "system", "regime").agg(F.count("*").alias("n"), F.avg("r").alias("mean")).where("n >= 20")
    return g.withColumn("place", F.row_number().over(W.orderBy(F.desc("mean"), "strategy", "system", "regime"))).withColumn("mean", F.round("mean", 6))


@query(
    "g02_top_conviction",
    f"WITH {TRADES}, g AS (SELECT regime, avg(r) * 10 AS c FROM trades GROUP BY 1 HAVING avg(r) <> 0), s AS (SELECT *, abs(c) >= 0.35 AS strong, bool_or(abs(c) >= 0.35) OVER () AS any_strong FROM g), k AS (SELECT *, row_number() OVER (ORDER BY abs(c) DESC, regime) AS k FROM s WHERE strong OR NOT any_strong) SELECT regime, round(c, 6) AS conviction, k AS place FROM k WHERE k <= 3",
)
def top_conviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest among those of at least 0.35, or among all if there is none."""
    g = trades(spark, sf_dir).groupBy("regime").agg((F.avg("r") * 10).alias("c")).where("c <> 0")
    s = g.withColumn("strong", F.abs("c") >= 0.35).withColumn("any_strong", F.bool_or("strong").over(W.partitionBy()))
    k = s.where("strong or not any_strong").withColumn("place", F.row_number().over(W.orderBy(F.desc(F.abs("c")), "regime")))
    return k.where("place <= 3").select("regime", F.round("c", 6).alias("conviction"), "place")


@query("g03_top_per_group", f"WITH {TRADES}, k AS (SELECT regime, trade_id, pnl, row_number() OVER (PARTITION BY regime ORDER BY pnl DESC, order_id, line_no, notional) AS k FROM trades) SELECT regime, trade_id, pnl FROM k WHERE k = 1")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best trade of each regime, kept by a partial aggregation."""
    best = F.max(F.struct("pnl", (-F.col("order_id")).alias("a"), (-F.col("line_no")).alias("b"), (-F.col("notional")).alias("c"), "trade_id"))
    return trades(spark, sf_dir).groupBy("regime").agg(best.alias("t")).select("regime", "t.trade_id", "t.pnl")


@query(
    "g04_best_by_regime",
    f"WITH {TRADES}, c AS (SELECT regime, strategy, system, avg(r) / nullif(stddev_samp(r), 0) AS s FROM trades GROUP BY ALL), m AS (SELECT regime, strategy, avg(greatest(s, -1)) AS s FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY s DESC, strategy) AS k FROM m) SELECT regime, strategy, round(s, 6) AS sharpe FROM k WHERE k = 1",
)
def best_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapewright.operators.metrics import safe

    c = trades(spark, sf_dir).groupBy("regime", "strategy", "system").agg(safe(F.avg("r"), F.stddev_samp("r")).alias("s"))
    g = c.groupBy("regime", "strategy").agg(F.avg(F.greatest("s", F.lit(-1.0))).alias("s"))
    k = g.withColumn("k", F.row_number().over(W.partitionBy("regime").orderBy(F.desc("s"), "strategy")))
    return k.where("k = 1").select("regime", "strategy", F.round("s", 6).alias("sharpe"))


HORIZONS = [1, 5, 10]


@query(
    "g05_best_horizon",
    f"WITH {BARS}, f AS (SELECT symbol, bar_no, close / lag(close, 5) OVER w - 1 AS x, {', '.join(f'lead(close, {h}) OVER w / close - 1 AS y{h}' for h in HORIZONS)} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)), c AS ("
    + " UNION ALL ".join(f"SELECT symbol, {h} AS horizon, corr(x, y{h}) AS ic FROM f GROUP BY 1" for h in HORIZONS)
    + "), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(ic) DESC, horizon) AS k FROM c) SELECT symbol, horizon, round(ic, 6) AS ic FROM k WHERE k = 1",
)
def best_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon whose forward return goes best with a signal, all horizons in one aggregation."""
    from tapewright.operators.metrics import correlation

    w = W.partitionBy("symbol").orderBy("bar_no")
    f = bars(spark, sf_dir).select("symbol", (F.col("close") / F.lag("close", 5).over(w) - 1).alias("x"), *((F.lead("close", h).over(w) / F.col("close") - 1).alias(f"y{h}") for h in HORIZONS))
    c = f.groupBy("symbol").agg(*(correlation("x", f"y{h}").alias(f"ic{h}") for h in HORIZONS))
    options = F.array(*(F.struct(F.abs(f"ic{h}").alias("a"), F.lit(-h).alias("h"), F.col(f"ic{h}").alias("ic")) for h in HORIZONS))
    best = c.select("symbol", F.array_max(options).alias("b"))
    return best.select("symbol", (-F.col("b.h")).alias("horizon"), F.round("b.ic", 6).alias("ic"))


@query("g06_tail", f"WITH {TICKS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS k FROM ticks) SELECT symbol, event_id, price FROM k WHERE k <= 200")
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention: the last 200 ticks of each symbol (the limit is the feature)."""
    k = ticks(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("event_id"))))
    return k.where("k <= 200").select("symbol", "event_id", "price")


@query("h01_union_shards", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with different columns; what a shard lacks is null."""
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return new.unionByName(old, allowMissingColumns=True)


@query("h02_complete_rows", f"WITH {BARS}, f AS (SELECT symbol, bar_no, close / lag(close, 5) OVER w - 1 AS x, lead(close, 5) OVER w / close - 1 AS y FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)) SELECT symbol, bar_no, round(x, 6) AS x, round(y, 6) AS y FROM f WHERE x IS NOT NULL AND y IS NOT NULL")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("symbol").orderBy("bar_no")
    f = bars(spark, sf_dir).select("symbol", "bar_no", F.round(F.col("close") / F.lag("close", 5).over(w) - 1, 6).alias("x"), F.round(F.lead("close", 5).over(w) / F.col("close") - 1, 6).alias("y"))
    return f.dropna(subset=["x", "y"])


@query("h03_intersect", f"{two()} SELECT ts FROM x INTERSECT SELECT ts FROM y")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = pair(spark, sf_dir)
    return x.select("ts").intersect(y.select("ts"))


@query("h04_rest_by_value", f"WITH {TRADES} SELECT trade_id, line_no, r FROM trades WHERE r NOT IN (SELECT r FROM trades WHERE quantity > 45 AND r IS NOT NULL)")
def rest_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after taking out every row whose value occurs among the filtered ones."""
    t = trades(spark, sf_dir).select("trade_id", "line_no", "r", "quantity").where("r is not null")
    return t.join(t.where("quantity > 45").select("r").distinct(), "r", "left_anti").select("trade_id", "line_no", "r")


@query("h05_ordered_distinct", f"WITH {TICKS}, f AS (SELECT user_id, symbol, min((ts, event_id)) AS first FROM ticks GROUP BY ALL) SELECT user_id, list(symbol ORDER BY first) AS symbols FROM f GROUP BY 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of each user in the order of their first event; reduced to one row a symbol before they are listed."""
    f = ticks(spark, sf_dir).groupBy("user_id", "symbol").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return f.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "symbol"))), lambda x: x["symbol"]).alias("symbols"))


@query(
    "h06_purged_folds",
    f"WITH {BARS}, n AS (SELECT symbol, max(bar_no) AS n FROM bars GROUP BY 1), f AS (SELECT symbol, n, unnest(range(1, 5)) AS fold FROM n), b AS (SELECT symbol, fold, n * fold // 5 AS cut, n * (fold + 1) // 5 AS stop FROM f) SELECT symbol, fold, count(*) FILTER (bar_no <= cut - 5) AS train, count(*) FILTER (bar_no > cut + 2 AND bar_no <= stop) AS test FROM bars JOIN b USING (symbol) GROUP BY ALL",
)
def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding folds in time: five bars purged before the cut, two embargoed after it."""
    b = bars(spark, sf_dir).select("symbol", "bar_no", F.max("bar_no").over(W.partitionBy("symbol")).alias("n")).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(4))))
    cut, stop = F.floor(F.col("n") * F.col("fold") / 5), F.floor(F.col("n") * (F.col("fold") + 1) / 5)
    return b.groupBy("symbol", "fold").agg(F.count_if(F.col("bar_no") <= cut - 5).alias("train"), F.count_if((F.col("bar_no") > cut + 2) & (F.col("bar_no") <= stop)).alias("test"))

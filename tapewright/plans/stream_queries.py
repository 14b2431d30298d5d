"""Structured Streaming jobs, run over files until all that is available has been read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.plans.registry import Registry
from tapewright.plans.simulation_queries import PAPER, signals
from tapewright.plans.sql import BARS, TICKS
from tapewright.sources.market import bars, table, ticks
from tapewright.sources.staging import scratch
from tapewright.streaming import ticks as st

query = Registry()
QUERIES, SQL = query.queries, query.sql


SLICES = 4
#: Decisions of a bucket, of which a slice is in the state at a time.
BUCKET_ROWS = 8_192
STORE = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Arrival:
    """A stream of rows that arrive in slices of time: each slice's files are moved in whole, and only then read."""

    stream: DataFrame
    staged: str
    source: str

    def deliver(self, part: int) -> None:
        spark = self.stream.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        came = path(f"{self.staged}/batch={part}")
        fs = came.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(came):
            fs.rename(came, path(f"{self.source}/batch={part}"))


def moment(c: str, kind: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.col(c)


def cuts(rows: DataFrame, order: str, slices: int | None = None) -> list:
    """Where slices of time end."""
    n = slices or SLICES
    return rows.agg(F.percentile_approx(moment(order, dict(rows.dtypes)[order]), [i / n for i in range(1, n)], 1000)).first()[0] or [] if n > 1 else []


def arriving(spark: SparkSession, rows: DataFrame, name: str, order: str, ends: list | None = None) -> Arrival:
    """``rows`` as a stream of slices (of up to each of ``ends``); all slices are written in one pass, by all tasks."""
    at = moment(order, dict(rows.dtypes)[order])
    part = sum(((at > c).cast("int") for c in (cuts(rows, order) if ends is None else ends)), F.lit(0))
    staged, source = scratch(spark, f"{name}-staged"), scratch(spark, f"{name}-in")
    rows.withColumn("batch", part).write.partitionBy("batch").parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/batch=none")  # so that there is a folder before the first slice
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return Arrival(spark.readStream.schema(rows.schema).parquet(f"{source}/batch=*"), staged, source)


def finished(spark: SparkSession, out: DataFrame, name: str, *arrivals: Arrival) -> DataFrame:
    """What the stream ``out`` gives out: run on each slice as it has arrived, from where the checkpoint says it was.

    So the order of slices is that of delivery; clocks, names and times of files have no part in it.
    """
    sink, state = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state")
    for part in range(SLICES):
        for a in arrivals:
            a.deliver(part)
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def available(spark: SparkSession, rows: DataFrame, job: Callable[[DataFrame], DataFrame], name: str, order: str = "ts") -> DataFrame:
    """What ``job`` gives out when ``rows`` arrive in time order."""
    came = arriving(spark, rows, name, order)
    return finished(spark, job(came.stream), name, came)


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def stamped_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("l03_tumbling_bars", f"WITH {BARS}, e AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events) SELECT symbol, ts, open, high, low, close, volume, n_ticks FROM bars, e WHERE ts + INTERVAL 1 HOUR <= mark")
def tumbling_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that the watermark has closed when the stream ends."""
    out = available(spark, stamped(spark, sf_dir), st.tumbling_bars, "bars")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("l11_once", f"WITH {TICKS} SELECT event_id, symbol, price FROM ticks")
def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stamped(spark, sf_dir)
    twice = t.unionByName(t.where("event_id % 7 = 0"))
    return available(spark, twice, st.once, "once").select("event_id", "symbol", "price")


@query("l08_silence", f"WITH {TICKS}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) > INTERVAL 2 HOUR AS far FROM ticks), s AS (SELECT *, sum(coalesce(far, true)::INT) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), w AS (SELECT symbol, k, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY ALL) SELECT symbol, start, last, n FROM w WHERE last + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 3 HOUR FROM events)")
def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = available(spark, stamped(spark, sf_dir), st.sessions, "silence")
    return out.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query("l04_session_vwap", f"WITH {TICKS}, v AS (SELECT symbol, event_id, ts, price, sum(price * size) OVER w / nullif(sum(size) OVER w, 0) AS vwap FROM ticks WINDOW w AS (PARTITION BY symbol, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT symbol, event_id, round(coalesce(vwap, price), 6) AS vwap FROM v")
def session_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = available(spark, stamped(spark, sf_dir), st.session_vwap, "vwap")
    return out.select("symbol", "event_id", F.round("vwap", 6).alias("vwap"))


@query("l05_opening_range", f"WITH {BARS}, d AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) AS k FROM bars), r AS (SELECT symbol, ts::DATE AS day, max(high) AS hi, min(low) AS lo FROM d WHERE k <= 3 GROUP BY ALL) SELECT d.symbol, d.bar_no, CASE WHEN close > hi AND volume > 100 THEN 1 WHEN close < lo AND volume > 100 THEN -1 ELSE 0 END AS signal FROM d JOIN r ON d.symbol = r.symbol AND d.ts::DATE = r.day WHERE k > 3")
def opening_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of the range of a day's first three bars, on volume, as bars arrive."""
    return available(spark, stamped_bars(spark, sf_dir), st.opening_range, "opening")


@query("l06_order_timeout", "WITH o AS (SELECT event_id AS order_id, ts AS placed FROM events WHERE event_type = 'purchase'), f AS (SELECT event_id AS fill_order, ts + to_seconds(CAST(event_id % 300 AS INTEGER)) AS filled FROM events WHERE event_type = 'purchase' AND event_id % 4 <> 0), j AS (SELECT order_id, placed, filled FROM o LEFT JOIN f ON order_id = fill_order AND filled <= placed + INTERVAL 180 SECOND) SELECT order_id, CASE WHEN filled IS NULL THEN 'CANCELLED_NO_FILL' ELSE 'FILLED' END AS status FROM j WHERE filled IS NOT NULL OR placed < TIMESTAMP '2024-01-30'")
def order_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and fills as two streams; what is not filled in 180 seconds is cancelled once the watermarks say so."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    orders = e.select(F.col("event_id").alias("order_id"), F.col("ts").cast("timestamp").alias("placed"))
    fills = e.where("event_id % 4 <> 0").select(F.col("event_id").alias("fill_order"), F.expr("cast(ts as timestamp) + make_interval(0, 0, 0, 0, 0, 0, event_id % 300)").alias("filled"))
    came = arriving(spark, orders, "orders", "placed"), arriving(spark, fills, "fills", "filled")
    return finished(spark, st.fills_in_time(*(a.stream for a in came)), "timeout", *came).where("filled is not null or placed < '2024-01-30'").select("order_id", "status")


@query("j07_paper_trades", PAPER)
def paper_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The life of paper trades as keyed state; the same whether bars come in one batch or in many."""
    rows = signals(spark, sf_dir, "ts").withColumnRenamed("atr", "risk").withColumn("ts", F.col("ts").cast("timestamp"))
    return available(spark, rows, st.paper_trades, "paper")


@query("l07_stale_decisions", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'labelled' WHEN date_diff('hour', o_orderdate, (SELECT max(o_orderdate) FROM orders)) > 48 THEN 'expired' ELSE 'pending' END AS status FROM orders")
def stale_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and their outcomes (up to 36 hours later, none after the last order) as two streams; timers end the wait for an outcome.

    What has neither an outcome nor run out when the streams end is pending, and is all that the state still holds.
    """
    o = table(spark, sf_dir, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    last = o.agg(F.max("ts").alias("last"))
    came = F.least(F.expr("ts + make_interval(0, 0, 0, 0, cast(o_orderkey % 37 as int), 0, 0)"), F.col("last"))
    decisions = o.select(F.col("o_orderkey").alias("decision"), "ts")
    outcomes = o.where("o_orderstatus = 'F'").join(F.broadcast(last)).select(F.col("o_orderkey").alias("decision"), came.alias("ts"))
    ends, buckets = cuts(decisions, "ts"), max(16, -(-decisions.count() // BUCKET_ROWS))
    both = arriving(spark, decisions, "decisions", "ts", ends), arriving(spark, outcomes, "outcomes", "ts", ends)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, st.ROCKS)
    try:
        told = finished(spark, st.stale(*(a.stream for a in both), buckets=buckets), "stale", *both)
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    open_ = decisions.join(told, "decision", "left_anti").select("decision", F.lit("pending").alias("status"))
    return told.unionByName(open_).withColumnRenamed("decision", "o_orderkey")


@query("l09_new_since", f"WITH {TICKS} SELECT symbol, count(*) AS n, max(event_id) AS mark FROM ticks WHERE event_id > (SELECT max(event_id) // 2 FROM ticks) GROUP BY 1")
def new_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has come since the last look: a stream's checkpoint is the mark, and ids past the half come after it."""
    t = ticks(spark, sf_dir)
    half = t.agg(F.floor(F.max("event_id") / 2)).first()[0]
    source, sink, state = (scratch(spark, f"pulse-{x}") for x in ("in", "out", "state"))
    late = F.col("event_id") > F.lit(half)
    for run, rows in enumerate((t.where(~late), t.where(late))):
        rows.write.parquet(f"{source}/part={run}")
        new = st.take_new(spark, source, t.schema, sink, state, run)
    return new.groupBy("symbol").agg(F.count("*").alias("n"), F.max("event_id").alias("mark"))


@query("l10_anomalies", f"WITH {BARS}, x AS (SELECT symbol, bar_no, close < open AS loss, min(close) OVER w = max(close) OVER w AND count(*) OVER w = 5 AS stuck FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), y AS (SELECT *, bar_no - coalesce(max(CASE WHEN NOT loss THEN bar_no END) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING), 0) AS streak FROM x) SELECT symbol, bar_no, streak, stuck FROM y WHERE streak >= 3 OR stuck")
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three losses or more in a row, or a value that has not moved for five bars, as bars arrive."""
    return available(spark, stamped_bars(spark, sf_dir), st.anomalies, "odd")

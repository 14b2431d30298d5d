"""Tables the engine works on: ticks, bars, macro series and a trade ledger, read from Parquet.

All symbols live in one long table. Bars carry ``bar_no``, the number of the bar within its symbol, which orders
windows and joins; ticks that share a time are told apart by their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, event_id, price, size, user_id)."""
    size = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), size.alias("size"), "user_id")


def resample(ticks: DataFrame, unit: str = "hour", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """OHLCV bars by calendar unit: one partial aggregation and one shuffle of the bars' few values."""
    at = F.struct("ts", "event_id")
    bucket = F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")
    return ticks.groupBy(*keys, bucket).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"),
        F.count("*").alias("n_ticks"),
    )


def numbered(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return bars.withColumn("bar_no", F.row_number().over(W.partitionBy(*keys).orderBy("ts")).cast("long"))


def bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    return numbered(resample(ticks(spark, sf_dir), unit))


def macro_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily series (day, value): the mean order price, its days shifted onto those of the ticks.

    Orders lie years before ticks; the series is laid out so that its last day falls on 2024-01-31.
    """
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("value"))
    last = daily.agg(F.max("day").alias("last"))
    shift = F.datediff(F.lit("2024-01-31").cast("date"), F.col("last"))
    return daily.join(F.broadcast(last)).select(F.date_add("day", shift).alias("day"), "value")


#: What orders trades in time; line numbers repeat within orders, so the amounts tell the last ties apart.
IN_ORDER = ("exit_ts", "order_id", "line_no", "notional", "quantity", "pnl")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade ledger: a line item is a trade, its regime the order's priority, its result relative to a norm of 1.0.

    ``r`` is the result in risk units: revenue over the part of the price at risk, less one, in steps of 1e-4.
    """
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    pnl = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_extendedprice") * (F.lit(0.9) + F.col("l_tax")), 4)
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trade_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_returnflag").alias("strategy"),
        F.col("l_linestatus").alias("system"),
        F.col("o_orderpriority").alias("regime"),
        F.col("l_shipdate").alias("exit_ts"),
        F.col("o_orderdate").alias("entry_ts"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("notional"),
        pnl.alias("pnl"),
        F.round(pnl / (F.col("l_extendedprice") * 0.05), 4).alias("r"),
    )

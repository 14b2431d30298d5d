"""Streams of ticks: bars, session state, order timeouts and silence, over event time with watermarks.

Keyed state that depends on order is fed in the order of event time (``in_time_order``): rows wait in the state until
the watermark has passed them, so neither the order of files nor that of rows in a batch changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The state store that timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tumbling_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """OHLCV bars; a bar is given out once the watermark has passed its end, and ticks later than that are dropped."""
    at = F.struct("ts", "event_id")
    w = F.window("ts", width)
    made = ticks.withWatermark("ts", late).groupBy("symbol", w).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("n_ticks")
    )
    return made.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "n_ticks")


def once(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """Ticks without repeats that arrive within ``late``."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(ticks: DataFrame, gap: str = "2 hours", late: str = "3 hours") -> DataFrame:
    """Activity of each symbol between silences of ``gap``; the end of a session is when it went silent."""
    w = F.session_window("ts", gap)
    made = ticks.withWatermark("ts", late).groupBy("symbol", w).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return made.select("symbol", F.col("session_window.start").alias("start"), "last", "n")


def fills_in_time(orders: DataFrame, fills: DataFrame, seconds: int = 180) -> DataFrame:
    """Orders with the fill that comes within ``seconds``, or none: a stream-stream join whose state ends with the watermarks."""
    o = orders.withWatermark("placed", "10 minutes")
    f = fills.withWatermark("filled", "10 minutes")
    inside = F.expr(f"order_id = fill_order and filled >= placed and filled <= placed + interval {seconds} seconds")
    j = o.join(f, inside, "leftOuter")
    return j.select("order_id", "placed", "filled", F.when(F.col("filled").isNull(), "CANCELLED_NO_FILL").otherwise("FILLED").alias("status"))


def in_time_order(rows: DataFrame, by: str, order: Sequence[str], start: tuple, step: Callable[[object, pd.DataFrame, tuple], tuple[tuple, list[tuple]]], out: str, state: str, late: str = "0 seconds") -> DataFrame:
    """What ``step`` makes of each key's rows, which it gets in order once the watermark (``late`` behind ``ts``) has passed them.

    ``step`` takes the key, rows and the state before them, and gives the state after them and rows of ``out``. Rows that
    the watermark has not reached wait in the state, their earliest time being the key's timeout; rows that come after
    the watermark are dropped by the engine.
    """
    names = [f.split()[0] for f in out.split(", ")]

    def take(key: tuple, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        *before, waiting = group.get if group.exists else (*start, b"")
        parts = [pa.ipc.open_stream(waiting).read_pandas()] if waiting else []
        parts += [f for f in frames if len(f)]
        if not parts:
            return
        frame = pd.concat(parts, ignore_index=True)
        passed = frame["_ms"] <= group.getCurrentWatermarkMs()
        after, made = step(key[0], frame[passed].sort_values(list(order), kind="stable"), tuple(before))
        rest = frame[~passed]
        held = b""
        if len(rest):
            table = pa.Table.from_pandas(rest, preserve_index=False)
            with (sink := pa.BufferOutputStream()), pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            held = sink.getvalue().to_pybytes()
        group.update((*after, held))
        if held:
            group.setTimeoutTimestamp(int(rest["_ms"].min()) - 1)
        yield pd.DataFrame(made, columns=names)

    marked = rows.withColumn("_ms", F.unix_millis("ts")).withWatermark("ts", late)
    return marked.groupBy(by).applyInPandasWithState(take, out, f"{state}, waiting binary", "append", "EventTimeTimeout")


VWAP_OUT = "symbol string, event_id long, vwap double, crossed int"
VWAP_STATE = "day string, value double, size double, above int"


def session_vwap(ticks: DataFrame) -> DataFrame:
    """Volume-weighted price since the day began and where the price crosses it, tick by tick.

    The state of a symbol is four numbers; a new day starts it anew.
    """

    def step(symbol: str, frame: pd.DataFrame, before: tuple) -> tuple[tuple, list[tuple]]:
        day, value, size, above = before
        rows = []
        for ts, event_id, price, n in zip(frame["ts"], frame["event_id"], frame["price"], frame["size"], strict=True):
            if (d := str(ts)[:10]) != day:
                day, value, size, above = d, 0.0, 0.0, 0
            value, size = value + price * n, size + n
            vwap = value / size if size else price
            side = 1 if price > vwap else -1 if price < vwap else 0
            rows.append((symbol, event_id, vwap, side if side and above and side != above else 0))
            above = side or above
        return (day, value, size, above), rows

    return in_time_order(ticks, "symbol", ["ts", "event_id"], ("", 0.0, 0.0, 0), step, VWAP_OUT, VWAP_STATE)


PAPER_OUT = "symbol string, opened long, closed long, reason string, r double"
PAPER_STATE = "side int, opened long, entry double, risk double, half boolean"


def paper_trades(bars: DataFrame) -> DataFrame:
    """Paper trades over a stream of bars with ``signal`` and ``risk``: stop first, half at one risk (stop to entry), rest at two."""

    def step(symbol: str, frame: pd.DataFrame, before: tuple) -> tuple[tuple, list[tuple]]:
        side, opened, entry, risk, half = before
        rows = []
        for b in frame.itertuples():
            if side:
                worst, best = (b.low, b.high) if side > 0 else (b.high, b.low)
                stop = entry if half else entry - side * risk
                if (worst - stop) * side <= 0:
                    rows.append((symbol, opened, int(b.bar_no), "EVEN" if half else "STOP", 0.5 if half else -1.0))
                    side = 0
                elif half and (best - entry) * side >= 2 * risk:
                    rows.append((symbol, opened, int(b.bar_no), "TP2", 1.5))
                    side = 0
                elif (best - entry) * side >= risk:
                    half = True
            elif b.signal and b.risk > 0:
                side, opened, entry, risk, half = int(b.signal), int(b.bar_no), float(b.close), float(b.risk), False
        return (side, opened, entry, risk, half), rows

    return in_time_order(bars, "symbol", ["bar_no"], (0, 0, 0.0, 0.0, False), step, PAPER_OUT, PAPER_STATE)


RANGE_OUT = "symbol string, bar_no long, signal int"
RANGE_STATE = "day string, seen int, hi double, lo double"


def opening_range(bars: DataFrame, first: int = 3, loud: float = 100.0) -> DataFrame:
    """Breaks of the range of a day's ``first`` bars, on volume, bar by bar; the state of a symbol is a day's range."""

    def step(symbol: str, frame: pd.DataFrame, before: tuple) -> tuple[tuple, list[tuple]]:
        day, seen, hi, lo = before
        rows = []
        for b in frame.itertuples():
            if (d := str(b.ts)[:10]) != day:
                day, seen, hi, lo = d, 0, float("-inf"), float("inf")
            seen += 1
            if seen <= first:
                hi, lo = max(hi, b.high), min(lo, b.low)
            else:
                rows.append((symbol, b.bar_no, (b.volume > loud) * ((b.close > hi) - (b.close < lo))))
        return (day, seen, hi, lo), rows

    return in_time_order(bars, "symbol", ["bar_no"], ("", 0, 0.0, 0.0), step, RANGE_OUT, RANGE_STATE)


ODD_OUT = "symbol string, bar_no long, streak long, stuck boolean"
ODD_STATE = "streak long, value double, same long"


def anomalies(bars: DataFrame, losses: int = 3, still: int = 5) -> DataFrame:
    """Bars at the end of ``losses`` falling bars or more, or at which the close has not moved for ``still`` bars."""

    def step(symbol: str, frame: pd.DataFrame, before: tuple) -> tuple[tuple, list[tuple]]:
        streak, value, same = before
        rows = []
        for b in frame.itertuples():
            streak = streak + 1 if b.close < b.open else 0
            value, same = b.close, same + 1 if b.close == value else 1
            if streak >= losses or same >= still:
                rows.append((symbol, b.bar_no, streak, same >= still))
        return (streak, value, same), rows

    return in_time_order(bars, "symbol", ["bar_no"], (0, float("nan"), 0), step, ODD_OUT, ODD_STATE)


class Expiry(StatefulProcessor):
    """Decisions wait for their outcomes, for ``hours`` of event time at most; a timer at the earliest end of a bucket ends waits.

    A key is a bucket of decisions, so that a call of Python takes many of them at once: the state of a bucket is a table of
    what is open (``ms``: when it was placed) and of outcomes that came first (``ms``: -1), and the time of its timer.
    """

    def __init__(self, hours: int) -> None:
        self.wait = hours * 3_600_000 + 1  # a decision of just this age is not stale yet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "held binary, timer long")

    def close(self) -> None:
        pass

    def held(self) -> tuple[pd.DataFrame, int | None]:
        if not self.bucket.exists():
            return pd.DataFrame({"decision": np.zeros(0, np.int64), "ms": np.zeros(0, np.int64)}), None
        held, timer = self.bucket.get()
        x = np.frombuffer(held, np.int64).reshape(2, -1)
        return pd.DataFrame({"decision": x[0], "ms": x[1]}), timer

    def hold(self, rest: pd.DataFrame, timer: int | None) -> None:
        """Keep ``rest`` and have the timer at the earliest end in it."""
        waiting = rest.loc[rest["ms"] >= 0, "ms"]
        at = int(waiting.min()) + self.wait if len(waiting) else None
        if timer != at:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        if len(rest):
            self.bucket.update((np.stack([rest["decision"], rest["ms"]]).astype(np.int64).tobytes(), at))
        elif self.bucket.exists():
            self.bucket.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, timer = self.held()
        frame = pd.concat(list(rows))
        came = pd.DataFrame({"decision": frame["decision"], "ms": frame["ms"].where(frame["placed"], -1)})
        every = pd.concat([before, came]).sort_values(["decision", "ms"]).drop_duplicates(["decision", "ms"])
        done = every["ms"] < 0
        placed = every[~done].drop_duplicates("decision")  # the earliest
        over = placed["decision"].isin(every.loc[done, "decision"])
        labelled = placed.loc[over, "decision"]
        self.hold(pd.concat([placed[~over], every[done & ~every["decision"].isin(labelled)]]), timer)
        yield pd.DataFrame({"decision": labelled.to_numpy(), "status": "labelled"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, timer = self.held()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = (before["ms"] >= 0) & (before["ms"] + self.wait <= now)
        self.hold(before[~over], None)  # the timer that fired is gone
        yield pd.DataFrame({"decision": before.loc[over, "decision"].to_numpy(), "status": "expired"})


def stale(decisions: DataFrame, outcomes: DataFrame, hours: int = 48, late: str = "0 seconds", buckets: int = 16) -> DataFrame:
    """``labelled`` or ``expired`` for each decision once its outcome, or the end of its time, has come.

    Both streams have ``decision`` (an integer) and ``ts``; what neither has happened to yet is only in the state, which is dealt
    into ``buckets`` by the decision's hash.
    """
    mark = lambda df, placed: df.select("decision", "ts", F.unix_millis("ts").alias("ms"), F.lit(placed).alias("placed"))
    both = mark(decisions, True).unionByName(mark(outcomes, False)).where("decision is not null").withWatermark("ts", late)
    return both.withColumn("bucket", F.pmod(F.xxhash64("decision"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(Expiry(hours), "decision long, status string", "append", "EventTime")


def take_new(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, run: int) -> DataFrame:
    """What has come into the folder ``source`` since the last call with this checkpoint, which keeps the mark.

    Batches are written under the run's number, so that a batch that is repeated after a failure replaces itself.
    """
    target = f"{sink}/run={run}"
    stream = spark.readStream.schema(schema).parquet(f"{source}/*")
    put = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(target)

"""One account over many symbols: positions sized by the equity at entry, folded over ranges of time.

Within a step positions are closed, then new ones opened with a share of what the account then has. What a step does to
(equity, size of each symbol's position) is a linear map, so steps compose: each range of time becomes one matrix,
the matrices give the state at the start of each range, and every range is then replayed on its own. A series of any
length is folded by as many tasks as there are ranges; a matrix has as many rows as there are symbols, and one more.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators.blocks import BLOCK, ranged

OUT = "step timestamp_ntz, equity double, n_open int"


def _steps(frame: pd.DataFrame, risk: float) -> list[tuple[object, list[tuple[int, float]], list[int]]]:
    """(step, exits with their results, entries), exits and entries by symbol, in time order."""
    out = []
    for step, part in frame.sort_values(["step", "at"], kind="stable").groupby("step", sort=True):
        closes = part[part["ret"].notna()]
        out.append((step, list(zip(closes["at"].astype(int), closes["ret"], strict=True)), part.loc[part["ret"].isna(), "at"].astype(int).tolist()))
    return out


def _apply(state: np.ndarray, exits: Sequence[tuple[int, float]], entries: Sequence[int], risk: float) -> None:
    """A step, on one state or on the columns of a matrix: row 0 is the equity, row 1 + i the size of symbol i's position."""
    for i, ret in exits:
        state[0] += ret * state[1 + i]
        state[1 + i] = 0.0
    for i in entries:
        state[1 + i] = risk * state[0]


def shared_equity(trades: DataFrame, start: float = 100_000.0, risk: float = 0.25, symbol: str = "symbol") -> DataFrame:
    """(step, equity, n_open) after each step at which a position of the account is opened or closed.

    ``trades`` has symbol, opened, closed (times) and ret (result of a unit of size); a symbol's trades do not overlap. Equal times of
    different symbols are one step, whatever their order. A trade's size is ``risk`` of the equity when it is opened.
    """
    spark = trades.sparkSession
    numbers = {r[0]: i for i, r in enumerate(trades.select(symbol).distinct().orderBy(symbol).collect())}  # a row a symbol
    known = F.broadcast(spark.createDataFrame(list(numbers.items()), trades.select(symbol, F.lit(0).alias("at")).schema))
    each = trades.join(known, symbol)
    events = each.select(F.col("opened").alias("step"), "at", F.lit(None).cast("double").alias("ret")).unionByName(each.select(F.col("closed").alias("step"), "at", F.col("ret").cast("double").alias("ret")))
    rows = ranged(events, [], ["step"])
    size = 1 + len(numbers)

    def composed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        m = np.eye(size)
        for _, exits, entries in _steps(frame, risk):
            _apply(m, exits, entries, risk)
        return pd.DataFrame({BLOCK: [key[0]], "map": [m.ravel().tolist()]})

    maps = rows.groupBy(BLOCK).applyInPandas(composed, f"{BLOCK} int, map array<double>").orderBy(BLOCK).collect()  # a row a range
    state = np.zeros(size)
    state[0] = start
    states = []
    for r in maps:
        states.append((r[BLOCK], state.tolist()))
        state = np.array(r["map"]).reshape(size, size) @ state
    starts = spark.createDataFrame(states, f"{BLOCK} int, state array<double>")

    def replayed(key: tuple, frame: pd.DataFrame, begins: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["step", "equity", "n_open"])
        now = np.array(begins["state"].iloc[0], dtype=float)
        out = []
        for step, exits, entries in _steps(frame, risk):
            _apply(now, exits, entries, risk)
            out.append((step, now[0], int(np.count_nonzero(now[1:]))))
        return pd.DataFrame(out, columns=["step", "equity", "n_open"])

    return rows.groupBy(BLOCK).cogroup(starts.groupBy(BLOCK)).applyInPandas(replayed, OUT)


def drawdown(equity: DataFrame, start: float = 100_000.0) -> DataFrame:
    """``equity`` with how far it is below its highest value so far, over ranges of time."""
    parts = ranged(equity, [], ["step"])
    tops = parts.groupBy(BLOCK).agg(F.max("equity").alias("_top"))
    before = tops.select(BLOCK, F.greatest(F.max("_top").over(W.orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)), F.lit(start)).alias("_before"))
    inside = F.max("equity").over(W.partitionBy(BLOCK).orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    peak = F.greatest(F.col("_inside"), F.col("_before"))
    return parts.withColumn("_inside", inside).join(F.broadcast(before), BLOCK).withColumn("drawdown", F.col("equity") / peak - 1).drop("_inside", "_before", BLOCK)

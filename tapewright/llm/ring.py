"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring. A key belongs to the first point at or after its own hash;
if that shard is full, the key continues clockwise to the next point whose shard has room. Capacities are the
floor or ceiling of rows / shards, so counts end at most one apart whatever the keys look like.

How it is distributed: only the number of keys on each arc decides where keys overflow to, so the driver gets
one count per virtual node (a bound that does not grow with the data) and returns, for each arc, ranges of ranks
and their shard. Executors then rank rows within (arc, slice of the arc) and look their range up.

Defined results: a null key hashes like a fixed value; repeated keys and rows are separate rows, ordered by an
own row number; values of any length pass through; an empty table gives an empty result; columns named ``shard`` or
``slot`` are replaced, others keep their names, whatever these are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.llm.common import others, require, written

SLICE_ROWS = 100_000


def ring_points(n_shards: int, vnodes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions (signed 64 bit) of all virtual nodes and the shard of each."""
    points = sorted(
        (int.from_bytes(hashlib.blake2b(f"{seed}/{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s)
        for s in range(n_shards)
        for v in range(vnodes)
    )
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points], dtype=np.int32)


def plan_overflow(counts: np.ndarray, owner: np.ndarray, n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges (arc, first rank, end rank, shard, first slot) that place every key under the capacities.

    Keys sit at their own arc first; those without room step to the next virtual node, arc by arc, until all have a
    place. The capacities add up to the number of keys, so every shard is exactly full at the end.
    """
    total = int(counts.sum())
    room = np.full(n_shards, total // n_shards, dtype=np.int64)
    room[: total % n_shards] += 1
    filled = np.zeros(n_shards, dtype=np.int64)
    waiting = [(a, a, 0, int(c)) for a, c in enumerate(counts) if c]
    ranges = []
    while waiting:
        later = []
        for arc, at, first, end in waiting:
            s = int(owner[at])
            n = min(end - first, int(room[s] - filled[s]))
            if n:
                ranges.append((arc, first, first + n, s, int(filled[s])))
                filled[s] += n
            if first + n < end:
                later.append((arc, (at + 1) % len(owner), first + n, end))
        waiting = later
    return sorted(ranges)


def bounded_ring(df: DataFrame, key: str, n_shards: int, vnodes: int = 64, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 within a shard)."""
    require(df, [key])
    if n_shards < 1 or vnodes < 1:
        raise ValueError("n_shards and vnodes must be positive")
    positions, owner = ring_points(n_shards, vnodes, seed)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(positions, h.to_numpy(), side="left") % len(positions)).astype("int32")

    given = F.struct(*others(df, "shard", "slot")).alias("given")
    rows = written(df.select(given, arc_of(F.xxhash64(F.col(key))).alias("_arc"), F.monotonically_increasing_id().alias("_row")), "ring")
    found = rows.groupBy("_arc").count().collect()  # one row per virtual node at most
    counts = np.zeros(len(positions), dtype=np.int64)
    for r in found:
        counts[r["_arc"]] = r["count"]
    ranges = plan_overflow(counts, owner, n_shards)
    slices = max(1, -(-int(counts.max(initial=0)) // SLICE_ROWS))

    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.lit(slices)).cast("int"))
    before = W.partitionBy("_arc").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    base = rows.groupBy("_arc", "_slice").agg(F.count("*").alias("_n")).select("_arc", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("_arc", "_slice").orderBy("_row")).cast("long") - 1)
    if slices > 1:
        ranked = ranked.join(base, ["_arc", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_base"))

    starts = [(r[0], r[1]) for r in ranges]

    @F.pandas_udf("struct<shard:int,slot:long>")
    def place(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = [bisect_left(starts, (a, k + 1)) - 1 for a, k in zip(arc.tolist(), rank.tolist(), strict=True)]
        got = [ranges[i] for i in at]
        return pd.DataFrame({"shard": np.array([g[3] for g in got], dtype=np.int32), "slot": np.array([g[4] - g[1] for g in got], dtype=np.int64) + rank.to_numpy(dtype=np.int64)})

    return ranked.select("given", place("_arc", "_rank").alias("_at")).select("given.*", "_at.shard", "_at.slot")

"""Best-fit packing of documents into training sequences by a grouping genetic algorithm.

A solution is a set of bins (sequences), and genes are whole bins. Crossover takes the well-filled bins of one parent,
drops from the other parent every bin that holds one of their documents, and puts the documents displaced by that into
bins by best fit, largest first. Mutation empties the worst bins of a solution in the same way.

A population begins with best fit of the items largest first and of items in random orders, and its solutions are bred
from there. Breeding ends once a bred solution needs no more bins than the lower bound (total length over capacity), or after so
many generations; the best bred solution is the result, and best fit's own only where none is as good (``bred`` of
``solutions`` says which).

How it is distributed: pieces are dealt at random into blocks of about ``block_rows``, and every block is evolved by
``islands`` independent populations, each in a task of its own and with a mutation rate of its own. After each epoch an
island's best solution migrates to the next island of its block (a row per bin, joined by Spark), once at least; at the end the
best solution of each block is taken.
Random blocks of thousands of pieces resemble the whole, so no more than a bin a block can be lost against packing all
at once; pieces as long as a sequence are sequences of their own.

Defined results: lengths from 1 to the capacity are packed and others (null too) are an error; repeated rows are
separate pieces; of solutions as good as each other bred ones go first, then that of the last epoch and first island; an empty table gives
an empty result; columns named ``sequence_id`` or ``offset`` are replaced, others pass through whatever their names and
however long their values.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.llm.common import join_counted, others, require, tidy, written

Bins = list[list[int]]
KEEP = 0.98


class Filled(list):
    """Bins that know their fills. Their lists are shared between solutions and never changed."""

    def __init__(self, bins: Bins, fill: list[int]) -> None:
        super().__init__(bins)
        self.fill = fill


class Open:
    """Bins by the room they have left, with the fullest that still fits found by bits."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by_room, self.mask = capacity, [[] for _ in range(capacity + 1)], 0

    def put(self, bins: Bins, fill: list[int]) -> None:
        by_room, capacity = self.by_room, self.capacity
        for members, f in zip(bins, fill, strict=True):
            by_room[capacity - f].append(members)
        self.mask = sum(1 << room for room, held in enumerate(by_room) if held)

    def fit(self, items: Sequence[int], sizes: list[int]) -> None:
        """Best fit of items in the given order: the least room of at least the item's size, else a new bin."""
        by_room, capacity, mask = self.by_room, self.capacity, self.mask
        for item in items:
            size = sizes[item]
            rooms = mask >> size
            if rooms:
                room = size + (rooms & -rooms).bit_length() - 1
                held = by_room[room]
                members = [*held.pop(), item]
                if not held:
                    mask ^= 1 << room
            else:
                room, members = capacity, [item]
            room -= size
            by_room[room].append(members)
            mask |= 1 << room
        self.mask = mask

    def bins(self) -> Filled:
        fill = [self.capacity - room for room, held in enumerate(self.by_room) for _ in held]
        return Filled([m for held in self.by_room for m in held], fill)


def fills(bins: Bins, sizes: list[int]) -> list[int]:
    if isinstance(bins, Filled):
        return bins.fill
    size = sizes.__getitem__
    return [sum(map(size, m)) for m in bins]


def refit(kept: Bins, loose: Sequence[int], sizes: list[int], capacity: int) -> Filled:
    """``kept`` bins, with loose items added by best fit, largest first."""
    bins = Open(capacity)
    bins.put(kept, fills(kept, sizes))
    bins.fit(sorted(sorted(loose), key=sizes.__getitem__, reverse=True), sizes)  # of equal sizes the first goes first
    return bins.bins()


def fitness(bins: Bins, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among equals those whose fill is less even."""
    return -len(bins), sum(f * f for f in fills(bins, sizes)) / capacity**2


def crossover(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Well-filled bins of ``a`` go into ``b``; b's bins that share an item with them go, their other items are refitted.

    Well-filled are those without room; if there are none, those filled to ``KEEP``, or else the fullest quarter.
    """
    fill = fills(a, sizes)
    least = max([f for f in (capacity, KEEP * capacity) if f <= max(fill, default=0)], default=sorted(fill)[-(-3 * len(fill) // 4) - 1] if fill else 0)
    full = [(m, f) for m, f in zip(a, fill, strict=True) if f >= least]
    injected = rng.sample(full, rng.randint(1, max(1, len(full) // 2))) if full else []
    taken = {i for m, _ in injected for i in m}
    apart = taken.isdisjoint
    kept, loose = injected, []
    for m, f in zip(b, fills(b, sizes), strict=True):
        if apart(m):
            kept.append((m, f))
        else:
            loose += [i for i in m if i not in taken]
    return refit(Filled([m for m, _ in kept], [f for _, f in kept]), loose, sizes, capacity)


def mutate(bins: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Empty the least filled bins and a few others."""
    fill = fills(bins, sizes)
    order = sorted(range(len(bins)), key=fill.__getitem__)
    n = min(len(order), max(2, len(order) // 20))
    gone = order[:n] + (rng.sample(order[n:], min(n, len(order) - n)))
    marked = set(gone)
    kept = [k for k in range(len(bins)) if k not in marked]
    return refit(Filled([bins[k] for k in kept], [fill[k] for k in kept]), [i for k in gone for i in bins[k]], sizes, capacity)


def in_order(order: Sequence[int], sizes: list[int], capacity: int) -> Bins:
    """Best fit of items in the given order."""
    bins = Open(capacity)
    bins.fit(order, sizes)
    return bins.bins()


def evolve(sizes: list[int], capacity: int, seed: int, start: list[Bins], population: int, generations: int, mutation: float = 0.5, patience: int = 12) -> tuple[Bins, bool]:
    """The best solution, and whether it was bred; of solutions of as many bins a bred one goes before one that was not.

    Breeding also ends after ``patience`` generations without a solution of fewer bins. The population begins with ``start`` (elites, which were bred), best fit largest first, and best fit in random orders.
    """
    rng = random.Random(seed)
    bound = -(-sum(sizes) // capacity)
    found = [(Filled(b, fills(b, sizes)), True) for b in start] + [(refit([], range(len(sizes)), sizes, capacity), False)]
    while len(found) < population:
        found.append((in_order(rng.sample(range(len(sizes)), len(sizes)), sizes, capacity), False))
    pool = [(fitness(b, sizes, capacity), bred, b) for b, bred in found]
    rank = lambda p: (p[0][0], p[1], p[0][1])
    best = max((p for p in pool if p[1]), key=rank, default=None)
    since = 0
    for _ in range(generations):
        into = max(rng.sample(pool, 2), key=rank)[2]
        child = crossover(rng.choice([p[2] for p in pool if p[2] is not into]), into, sizes, capacity, rng)
        if rng.random() < mutation:
            child = mutate(child, sizes, capacity, rng)
        made = (fitness(child, sizes, capacity), True, child)
        pool.append(made)
        pool.remove(min(pool, key=rank))
        since = 0 if best is None or made[0][0] > best[0][0] else since + 1
        best = made if best is None else max(best, made, key=rank)
        if -best[0][0] <= bound or since == patience:
            break
    _, bred, bins = max([*pool, *([best] if best else [])], key=rank)
    return bins, bred


def pack(df: DataFrame, length: str, capacity: int = 2048, block_rows: int = 8192, islands: int = 3, epochs: int = 3, population: int = 6, generations: int = 30, seed: int = 0) -> DataFrame:
    """``df`` with ``sequence_id`` (long) and ``offset`` (long, gapless from 0 within a sequence)."""
    require(df, [length])
    with tidy(df.sparkSession):
        return _packed(df, length, capacity, block_rows, islands, epochs, population, generations, seed)


def _packed(df: DataFrame, length: str, capacity: int, block_rows: int, islands: int, epochs: int, population: int, generations: int, seed: int) -> DataFrame:
    given = F.struct(*others(df, "sequence_id", "offset")).alias("given")
    valid = F.when(F.col(length).between(1, capacity), F.col(length).cast("int")).otherwise(F.raise_error(F.lit(f"a length is not between 1 and {capacity}")).cast("int"))
    rows = written(df.select(given, valid.alias("_size"), F.monotonically_increasing_id().alias("_row")), "pieces", keep=True)
    small = rows.where(F.col("_size") < capacity).select("_row", "_size")
    n_blocks = max(1, -(-small.count() // block_rows))
    items = small.withColumn("block", F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(n_blocks)))
    out = "block long, island int, bin long, _row long, at int, n_bins int, bound int, bred boolean"

    def island_of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """One island of one block: its items, and its own and its neighbour's solution as far as there are any."""
        block, island = int(key[0]), int(key[1])
        own = frame[frame["source"] == -1].sort_values("_row")
        row_ids, sizes = own["_row"].to_numpy(), own["_size"].astype("int64").tolist()
        elites = frame[frame["source"] >= 0].sort_values(["source", "bin", "at"])
        place = np.searchsorted(row_ids, elites["_row"].to_numpy()).tolist()
        source, first = elites["source"].to_numpy(), (elites["at"] == 0).to_numpy()
        cuts = [*np.flatnonzero(first).tolist(), len(place)]
        start = [[] for _ in np.unique(source)]
        for k, (lo, hi) in zip(np.unique(source[first], return_inverse=True)[1].tolist(), pairwise(cuts), strict=True):
            start[k].append(place[lo:hi])
        first_seed = hash((seed, block, island, len(start)))  # of integers, so the same in every process
        best, bred = evolve(sizes, capacity, first_seed, start, population, generations, (island + 1) / (islands + 1))
        order = [i for m in best for i in sorted(m)]
        counts = [len(m) for m in best]
        return pd.DataFrame(
            {
                "block": np.full(len(order), block, np.int64),
                "island": np.full(len(order), island, np.int32),
                "bin": np.repeat([int(row_ids[min(m)]) for m in best], counts).astype(np.int64),
                "_row": row_ids[order],
                "at": np.concatenate([np.arange(c, dtype=np.int32) for c in counts]) if counts else np.zeros(0, np.int32),
                "n_bins": np.full(len(order), len(best), np.int32),
                "bound": np.full(len(order), -(-sum(sizes) // capacity), np.int32),
                "bred": np.full(len(order), bred),
            }
        )

    none = lambda kind: F.lit(-1).cast(kind)
    base = items.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "_row", "_size", F.lit(-1).alias("source"), none("long").alias("bin"), none("int").alias("at"))
    feed, solutions = base, None
    for epoch in range(max(2, epochs)):
        solved = written(feed.groupBy("block", "island").applyInPandas(island_of, out), "islands", keep=True)
        numbered = solved.withColumn("epoch", F.lit(epoch))
        solutions = numbered if solutions is None else solutions.unionByName(numbered)
        if epoch + 1 >= epochs and epoch:
            break
        worse = solved.groupBy("block").agg(F.min("n_bins").alias("least"), F.min("bound").alias("bound"))
        worse = written((worse.where("least > bound") if epoch else worse).select("block"), "open-blocks")
        n_worse = worse.count()
        if not n_worse:
            break
        # elites stay, and a copy of each migrates to the next island of its block
        again = lambda df, n=n_worse, w=worse: join_counted(df, w, ["block"], "left_semi", n)
        to = F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)))).alias("to")
        elite = again(solved).select("block", to, "_row", none("int").alias("_size"), F.col("island").alias("source"), "bin", "at").withColumnRenamed("to", "island")
        feed = again(base).unionByName(elite.select(*base.columns))
    scores = solutions.groupBy("block").agg(F.min(F.struct("n_bins", (~F.col("bred")).alias("plain"), (-F.col("epoch")).alias("turn"), "island")).alias("best"))
    scores = written(scores.select("block", (-F.col("best.turn")).alias("epoch"), "best.island"), "best-islands", keep=True)
    chosen = join_counted(solutions, scores, ["block", "epoch", "island"], "inner", n_blocks).select("bin", "_row")
    placed = rows.join(chosen, "_row", "left")
    before = W.partitionBy("sequence_id").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    ids = placed.select("given", "_row", "_size", F.coalesce("bin", "_row").alias("sequence_id"))
    return ids.withColumn("offset", F.coalesce(F.sum(F.col("_size").cast("long")).over(before), F.lit(0).cast("long"))).select("given.*", "sequence_id", "offset")

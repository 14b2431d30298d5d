"""Running values over long ordered tables with few keys.

A window by such keys has as many tasks as there are keys, however long the table is. Here the table is dealt into
ranges of (keys, order) and written once; windows run within a range, and what a range takes over from those before it
comes from one small aggregate for each key and range. Keys may be empty: a whole table is one series then.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.sources.staging import staged

BLOCK = "_block"


def _name(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` in ranges of (by, order), numbered in ``_block``; rows equal in both are in one range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(parts, *map(_name, [*by, *order])).withColumn(BLOCK, F.spark_partition_id()), "ranges")


def _with_carried(rows: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with the values carried into their range; null keys are keys."""
    other = carried.withColumnsRenamed({c: f"_of_{c}" for c in (*by, BLOCK)})
    same = F.col(BLOCK) == F.col(f"_of_{BLOCK}")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(other, same, "left").drop(*(f"_of_{c}" for c in (*by, BLOCK)))


def _before(by: Sequence[str]):
    return W.partitionBy(*by).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], peers: bool = False) -> DataFrame:
    """``df`` with the running sum of each expression; with ``peers`` rows equal in order count for each other."""
    rows = ranged(df.withColumns({f"_x_{n}": x for n, x in sums.items()}), by, order)
    w = W.partitionBy(*by, BLOCK).orderBy(*order)
    w = w.rangeBetween(W.unboundedPreceding, 0) if peers else w.rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy(*by, BLOCK).agg(*(F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums))
    carried = totals.select(*by, BLOCK, *(F.sum(f"_t_{n}").over(_before(by)).alias(f"_c_{n}") for n in sums))
    inside = rows.select("*", *(F.sum(f"_x_{n}").over(w).alias(f"_r_{n}") for n in sums))
    out = _with_carried(inside, carried, by)
    zero = lambda c, n: F.coalesce(c, F.lit(0).cast(rows.schema[f"_x_{n}"].dataType))
    return out.select(*df.columns, *((zero(F.col(f"_c_{n}"), n) + zero(F.col(f"_r_{n}"), n)).alias(n) for n in sums))


def neighbour(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str, ahead: bool = False) -> DataFrame:
    """``df`` with ``value`` of the row before (``ahead``: after) it, null for a series' first (last) one."""
    rows = ranged(df, by, order)
    w, pick = W.partitionBy(*by, BLOCK).orderBy(*order), F.lead if ahead else F.lag
    edge = (F.min_by if ahead else F.max_by)(F.struct(F.col(value).alias("v")), F.struct(*order))
    edges = rows.groupBy(*by, BLOCK).agg(edge.alias("_edge"))
    carried = edges.select(*by, BLOCK, pick("_edge").over(W.partitionBy(*by).orderBy(BLOCK)).alias("_carried"))
    inside = rows.withColumn("_inside", pick(F.struct(F.col(value).alias("v"))).over(w))
    return _with_carried(inside, carried, by).select(*df.columns, F.coalesce("_inside", "_carried")["v"].alias(out))


def last_seen(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], backward: bool = False) -> DataFrame:
    """``df`` with each of ``values`` where it is null taken from the last row before (``backward``: first after) that has it."""
    turned = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    rows = ranged(df, by, turned)
    pick = F.min_by if backward else F.max_by
    held = rows.groupBy(*by, BLOCK).agg(*(pick(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"_h_{v}") for v in values))
    carried = held.select(*by, BLOCK, *(F.last(f"_h_{v}", ignorenulls=True).over(_before(by)).alias(f"_c_{v}") for v in values))
    w = W.partitionBy(*by, BLOCK).orderBy(*turned).rowsBetween(W.unboundedPreceding, 0)
    others = [c for c in df.columns if c not in values]
    inside = rows.select(*others, BLOCK, *(F.last(v, ignorenulls=True).over(w).alias(v) for v in values))
    out = _with_carried(inside, carried, by)
    return out.select(*(F.coalesce(c, f"_c_{c}").alias(c) if c in values else F.col(c) for c in df.columns))


def rows_at(df: DataFrame, order: str, places: Sequence[int]) -> list:
    """The rows at the given places (from 0, few of them) of ``df`` sorted by ``order``, in that order."""
    rows = ranged(df, [], [order])
    before, found = 0, []
    for r in rows.groupBy(BLOCK).count().orderBy(BLOCK).collect():  # a row for each range
        found += [(r[BLOCK], p - before + 1) for p in places if before <= p < before + r["count"]]
        before += r["count"]
    if not found:
        return []
    numbered = rows.where(F.col(BLOCK).isin([b for b, _ in found])).withColumn("_no", F.row_number().over(W.partitionBy(BLOCK).orderBy(order)))
    wanted = F.struct(BLOCK, "_no").isin([F.struct(F.lit(b).alias(BLOCK), F.lit(k).alias("_no")) for b, k in found])
    return numbered.where(wanted).orderBy(order).select(*df.columns).collect()

"""As-of, next-event and interval joins.

An as-of join is a union of both sides and the last seen value in time order, over ranges of key and time (``blocks``):
no pair of rows is made that is not in the result, and a single long series is spread like many short ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators import blocks


def asof_join(left: DataFrame, right: DataFrame, on: str, values: Sequence[str], by: Sequence[str] = (), forward: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with the ``values`` of the latest (``forward``: earliest) right row at or before (after) it.

    With ``strict`` rows at the same time do not match. Right rows must be unique in ``by`` and ``on``; null values
    on the right are passed over, as are rows before the first one (they give nulls).
    """
    side = 1 if strict != forward else 0  # of the right rows, so that they come first among equals or last
    kept = [c for c in left.columns if c not in values]
    probe = left.select(*kept, F.lit(1 - side).alias("_side"), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values))
    build = right.select(*by, on, *values, F.lit(side).alias("_side"))
    both = probe.withColumn("_probe", F.lit(True)).unionByName(build.withColumn("_probe", F.lit(False)), allowMissingColumns=True)
    return blocks.last_seen(both, by, [on, "_side"], values, backward=forward).where("_probe").select(*kept, *values)


def overlap_counts(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """``df`` with the number of rows whose interval overlaps its own, itself included.

    Sweep instead of a self join: intervals that began by the end, less those that ended before the start.
    """
    each = df.select("*", F.explode(F.array(F.struct(F.col(end).alias("x"), F.lit(1).alias("k")), F.struct(F.col(start).alias("x"), F.lit(-1).alias("k")))).alias("q"))
    probes = each.select(*df.columns, F.col("q.x").alias("_x"), F.col("q.k").alias("_k"), F.lit(0).alias("_begin"), F.lit(0).alias("_ended"))
    begins = df.select(*by, F.col(start).alias("_x"), F.lit(1).alias("_begin"), F.lit(0).alias("_ended"))
    ends = df.select(*by, F.col(end).alias("_x"), F.lit(0).alias("_begin"), F.lit(1).alias("_ended"))
    both = probes.unionByName(begins, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy("_x")
    counted = both.select(
        *df.columns,
        "_k",
        F.sum("_begin").over(w.rangeBetween(W.unboundedPreceding, 0)).alias("_b"),
        F.sum("_ended").over(w.rangeBetween(W.unboundedPreceding, -1)).alias("_e"),
    ).where("_k is not null")
    return counted.groupBy(*df.columns).agg((F.sum(F.when(F.col("_k") == 1, F.col("_b")).otherwise(0)) - F.sum(F.when(F.col("_k") == -1, F.coalesce("_e", F.lit(0))).otherwise(0))).alias("n_overlaps"))


def window_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, n: int, aggs: Sequence) -> DataFrame:
    """``left`` with aggregates over the right rows numbered from ``at`` to ``at`` + ``n``.

    Right rows are dealt into blocks of n + 1 numbers and a left row asks two blocks: an equi-join, whatever ``n`` is.
    """
    width = n + 1
    asks = left.withColumn("_block", F.explode(F.array(F.floor(F.col(at) / width), F.floor(F.col(at) / width) + 1)))
    have = right.withColumn("_block", F.floor(F.col("bar_no") / width)).withColumnRenamed("bar_no", "_no")
    keys = [*by, "_block"]
    pairs = asks.join(have, keys).where(F.col("_no").between(F.col(at), F.col(at) + n))
    return pairs.groupBy(*left.columns).agg(*aggs)


def asof_by_day(left: DataFrame, daily: DataFrame, at: str, day: str, values: Sequence[str], most: int = 100_000) -> DataFrame:
    """``left`` with the latest ``daily`` row of its day or before, for series of one row a day.

    The series is carried forward by turning each row into the days it holds for. Its rows are counted: up to ``most``
    it is sent to every executor and ``left`` is not shuffled; a longer one is joined by shuffle.
    """
    n = daily.count()
    by_day = W.orderBy(day)
    spans = daily.select(day, *values, F.lead(day).over(by_day).alias("_next"))
    final = left.agg(F.max(F.to_date(at)).alias("_final"))
    until = F.greatest(F.coalesce(F.date_sub("_next", 1), F.greatest(F.col("_final"), F.col(day))), F.col(day))
    days = spans.join(F.broadcast(final)).select(*values, F.explode(F.sequence(F.col(day), until)).alias("_day"))
    if n <= most:
        days = F.broadcast(days)
    return left.withColumn("_day", F.to_date(at)).join(days, "_day", "left").drop("_day")

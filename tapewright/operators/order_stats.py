"""Order statistics of groups of any size: the range that holds a rank is found by counts, and only that range is sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.sources.staging import staged

RANGES = 64


def quantiles(df: DataFrame, value: str, by: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """(by, *shares): exact quantiles, interpolated between neighbouring ranks; nulls do not count.

    Equal values are counted first. Edges that a sketch of bounded size gives cut each group into ranges; counts of ranges say
    which of them hold the wanted ranks, and only their values are put in order: a task never holds a group, but a range of it.
    """
    keys = list(by)
    counts = staged(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")), "counted-values")
    edges = counts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 4 * RANGES)).alias("_edges"), F.sum("_n").alias("_size"))
    edges = staged(edges, "quantile-edges")
    placed = counts.join(edges, keys) if keys else counts.join(F.broadcast(edges))
    placed = placed.withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    ranges = placed.groupBy(*keys, "_range", "_size").agg(F.sum("_n").alias("_in"))
    before = F.sum("_in").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_in")
    wanted = [F.struct(F.lit(n).alias("name"), r.alias("rank"), r_lit.alias("part")) for n, p in shares.items() for r, r_lit in ((F.floor((F.col("_size") - 1) * p), F.lit(0)), (F.ceil((F.col("_size") - 1) * p), F.lit(1)))]
    asked = ranges.withColumn("_before", before).withColumn("_asked", F.filter(F.array(*wanted), lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("_in")))).where(F.size("_asked") > 0)
    held = placed.join(F.broadcast(asked.select(*keys, "_range", "_before", "_asked")), [*keys, "_range"])  # at most two ranges a share and group
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    found = held.withColumn("_upto", upto).select(*keys, "_v", "_size", F.explode(F.filter("_asked", lambda w: (w["rank"] < F.col("_upto")) & (w["rank"] >= F.col("_upto") - F.col("_n")))).alias("w"))
    low = lambda n: F.max(F.when((F.col("w.name") == n) & (F.col("w.part") == 0), F.col("_v")))
    high = lambda n: F.max(F.when((F.col("w.name") == n) & (F.col("w.part") == 1), F.col("_v")))
    rest = lambda p: (F.max("_size") - 1) * p - F.floor((F.max("_size") - 1) * p)
    made = [(low(n) + (high(n) - low(n)) * rest(p)).alias(n) for n, p in shares.items()]
    return found.groupBy(*keys).agg(*made) if keys else found.agg(*made)

"""Exactly k of n rows, drawn at random again and again, without sorting all rows for each draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators.simulate import draw
from tapewright.sources.staging import staged

#: Numbers from 0 up to this are drawn.
RANGE = 1 << 48


def sums_of_draws(eligible: DataFrame, sizes: DataFrame, value: str, key: str, by: str, sims: int, seed: int = 11, width: float = 6.0) -> DataFrame:
    """(by, sim, n, total): the sum of ``value`` over ``n`` rows drawn without replacement from each group, ``sims`` times.

    ``sizes`` has (by, k), and n is k or the group's size if that is less. A draw is the k rows with the least hashes of (seed, by, sim,
    key); ties go by key, which tells the rows of a group apart. The k-th least of m hashes lies within ``width`` deviations
    of its expected place, so hashes below that band are counted and summed where the rows are, those above are passed over, and only
    the few in the band are sorted. A draw whose k-th hash is outside its band (checked by count) is made again with all rows.
    """
    rows = staged(eligible.select(by, F.col(key).alias("_key"), F.col(value).cast("double").alias("_x")), "eligible")
    groups = rows.groupBy(by).agg(F.count("*").alias("_m")).join(sizes.select(by, F.col("k").alias("_want")), by)
    groups = groups.withColumn("_k", F.least("_want", "_m")).where("_k > 0")
    share = F.col("_k") / F.col("_m")
    spread = width * F.sqrt(F.col("_k") * (F.col("_m") - F.col("_k") + 1) / F.col("_m")) / F.col("_m") + 2 / F.col("_m")
    bounds = groups.select(by, "_k", ((share - spread) * RANGE).cast("long").alias("_low"), F.when(F.col("_k") == F.col("_m"), F.lit(RANGE)).otherwise(((share + spread) * RANGE).cast("long")).alias("_high"))
    bounds = staged(bounds, "bounds")
    each = rows.join(F.broadcast(bounds), by).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))  # groups: a row each
    each = each.withColumn("_u", draw(F.lit(RANGE), seed, F.col(by), F.col("sim"), F.col("_key")))
    below, inside = F.col("_u") < F.col("_low"), (F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high"))
    sums = each.groupBy(by, "sim", "_k").agg(F.count_if(below).alias("_sure"), F.coalesce(F.sum(F.when(below, F.col("_x"))), F.lit(0.0)).alias("_sum"), F.count_if(inside).alias("_open"))
    sums = staged(sums, "draws")
    missed = sums.where("_sure > _k or _sure + _open < _k").select(by, "sim")
    again = staged(missed, "draws-again")
    if not again.isEmpty():
        n = again.count()
        odd = F.broadcast(again) if n <= 10_000 else again
        whole = each.join(odd, [by, "sim"])
        rank = F.row_number().over(W.partitionBy(by, "sim").orderBy("_u", "_key"))
        redone = whole.withColumn("_r", rank).where("_r <= _k").groupBy(by, "sim").agg(F.count("*").alias("n"), F.sum("_x").alias("total"))
        sums = sums.join(odd, [by, "sim"], "left_anti")
    rest = sums.withColumn("_left", F.col("_k") - F.col("_sure"))
    band = each.where(inside).select(by, "sim", "_u", "_key", "_x").join(rest.select(by, "sim", "_left"), [by, "sim"])
    taken = band.withColumn("_r", F.row_number().over(W.partitionBy(by, "sim").orderBy("_u", "_key"))).where("_r <= _left").groupBy(by, "sim").agg(F.sum("_x").alias("_more"))
    out = rest.join(taken, [by, "sim"], "left").select(by, "sim", F.col("_k").alias("n"), (F.col("_sum") + F.coalesce("_more", F.lit(0.0))).alias("total"))
    return out if again.isEmpty() else out.unionByName(redone.select(by, "sim", "n", "total"))

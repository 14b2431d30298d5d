"""Joins on lists, labels and events, and sequential selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tokens(text: Column, longer_than: int = 3) -> Column:
    """Different lower-case words of more than ``longer_than`` letters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), 1), lambda w: F.length(w) > longer_than))


def covered_by(candidates: DataFrame, rejected: DataFrame, key: str, text: str, by: Sequence[str], least: float) -> DataFrame:
    """``candidates`` with the share of their words that the most similar rejected text of the same group holds.

    Texts meet on the words they share (an inverted index), so no pair without a common word is made.
    """
    mine = candidates.select(key, *by, tokens(F.col(text)).alias("_w"))
    theirs = rejected.select(F.col(key).alias("_other"), *by, F.explode(tokens(F.col(text))).alias("_t"))
    shared = mine.select(key, *by, F.explode("_w").alias("_t"), F.size("_w").alias("_n")).join(theirs, [*by, "_t"]).groupBy(key, "_other").agg((F.count("*") / F.first("_n")).alias("_share"))
    best = shared.groupBy(key).agg(F.max("_share").alias("overlap"))
    overlap = F.coalesce("overlap", F.lit(0.0))
    return candidates.join(best, key, "left").withColumn("overlap", F.round(overlap, 6)).withColumn("skip", overlap > least)


def co_occurrence(df: DataFrame, group: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of items that occur in the same group, and each item's counts alone and in all.

    Items of a group are a set (as many as there are kinds of items), and its pairs are made from that set.
    """
    sets = df.select(group, item).where(F.col(item).isNotNull()).distinct().groupBy(group).agg(F.sort_array(F.collect_set(item)).alias("s"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b"))))))).select("col.a", "col.b").groupBy("a", "b").agg(F.count("*").alias("n"))
    singles = sets.select(F.explode("s").alias("item"), (F.size("s") == 1).alias("solo")).groupBy("item").agg(F.count("*").alias("fires"), F.count_if("solo").alias("solo_fires"))
    return pairs, singles


def still_open(events: DataFrame, key: str, kind: str, order: Sequence[str], opens: str, closes: Sequence[str]) -> DataFrame:
    """Keys whose latest opening event has no closing one after it; one pass keeps the latest of both."""
    at = F.struct(*order)
    relevant = events.where(F.col(kind).isin(opens, *closes))
    last = relevant.groupBy(key).agg(F.max_by(kind, at).alias("_last"), F.max(F.when(F.col(kind) == opens, at)).alias("opened"))
    return last.where(F.col("_last") == opens).select(key, "opened")


def capped_open(df: DataFrame, group: str, start: str, end: str, order: Sequence[str], most: int) -> DataFrame:
    """``df`` with ``accepted``: in time order a row is taken unless ``most`` taken rows of its group are still open.

    The choice depends on all choices before it, so a group is one ordered series. A task reads its groups one after another in
    batches, whatever their number and size, and holds no more than the ends that are open in the present one. A row without
    a start comes last and is taken; one without an end closes at once.
    """
    schema = df.withColumn("accepted", F.lit(True)).schema

    def numbers(column: pa.Array) -> list:
        kind = column.type
        return (column.cast(pa.int64()) if pa.types.is_timestamp(kind) else column.cast(pa.int32()) if pa.types.is_date32(kind) else column).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_until = object(), []
        for batch in batches:
            taken = []
            for g, a, b in zip(batch.column(group).to_pylist(), numbers(batch.column(start)), numbers(batch.column(end)), strict=True):
                if g != now:
                    now, open_until = g, []
                open_until = [x for x in open_until if x >= a] if a is not None else []
                taken.append(len(open_until) < most)
                if taken[-1] and b is not None:
                    open_until.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], names=[*batch.schema.names, "accepted"])

    dealt = df.repartition(group).sortWithinPartitions(group, *(F.asc_nulls_last(c) for c in order))
    return dealt.mapInArrow(run, schema)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row of each key: the last in ``order``."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same keys; keys of ``new`` must be unique."""
    return old.join(new, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def append_new(old: DataFrame, new: DataFrame, parts: Sequence[str], name: str = "trade_key") -> DataFrame:
    """Rows of ``new`` whose hashed key is not in ``old``, with that key; repeated keys are appended once."""
    keyed = new.withColumn(name, F.md5(F.concat_ws("|", *(F.col(p).cast("string") for p in parts))))
    return keyed.dropDuplicates([name]).join(old.select(name), name, "left_anti")

"""Ledgers and stores: JSON lines, CSV and Parquet files with the rules by which they are read and written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a fixed schema; lines that are not JSON are passed over."""
    fields = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    rows = spark.read.schema(T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])).option("mode", "PERMISSIVE").json(path)
    # the whole row is parsed, not only this column, so that a damaged line is known as one
    return rows.withColumn("_bad", F.col(CORRUPT).isNotNull()).where("not _bad").drop(CORRUPT, "_bad")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, required: Sequence[str] = ()) -> DataFrame:
    """CSV with a header; a required column that the header lacks is an error, other missing ones are null."""
    fields = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    raw = spark.read.option("header", True).csv(path)
    if missing := [c for c in required if c not in raw.columns]:
        raise ValueError(f"{path} lacks {missing}")
    return raw.select(*((F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields))


def present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Those of the wanted columns that there are, in their order."""
    return df.select(*(c for c in wanted if c in df.columns))


def prefer(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``primary``, and those of ``fallback`` whose keys it lacks."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), list(keys), "left_anti"))


def label_first(ledger: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: Sequence[str]) -> DataFrame:
    """``ledger`` with ``columns`` set from ``updates`` (one row for each key) in the first row of each key only."""
    from pyspark.sql import Window as W

    new = updates.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    ranked = ledger.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).join(new, list(keys), "left")
    hit = F.col("_hit") & (F.col("_k") == 1)
    return ranked.select(*(F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in ledger.columns))


FORMATS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")


def canonical_time(text: Column) -> Column:
    """A time in any known format as ``yyyy-MM-dd HH:mm:ss`` (UTC); anything else as it is."""
    parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"), text)


def same_time(a: Column, b: Column) -> Column:
    """Equal by day if either side is a date only, else by the hour; for canonical times."""
    date_only = (F.length(a) <= 10) | (F.length(b) <= 10)
    return F.when(date_only, F.left(a, F.lit(10)) == F.left(b, F.lit(10))).otherwise(F.left(a, F.lit(13)) == F.left(b, F.lit(13)))


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))

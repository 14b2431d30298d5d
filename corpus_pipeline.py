"""The corpus pipeline: quality rules, line dedup, near-dedup and packing, each stage written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import line_dedup, order_minhash, quality_rules
from tapewright.llm.common import table, written
from tapewright.llm.queries import packed_pieces


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the rules learned from the labels.

    A null or empty text has no words and goes; rows, repeated ones too, are judged one by one; labels may lack or repeat
    ids and have any further columns; without labels the base rules alone decide. Columns of ``docs`` pass as they are.
    """
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that came earlier in the corpus; every document stays, ``n_chars`` follows its text.

    A null text stays null, a text may become empty; equal rows keep the same lines, and a null doc_id comes first.
    """
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the least doc_id, a null one only where there is no other.

    Null and empty texts are equal texts, of which one stays; of rows equal in doc_id and text one stays.
    """
    return order_minhash.near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all that is left, with their places in training sequences.

    A null or empty text is one piece of one id; a text of any length is cut into pieces of a sequence each; repeated rows are
    pieces of their own. An empty table gives an empty result, here and in every stage.
    """
    return packed_pieces(docs)


STAGES = [("quality_rules", keep_good), ("line_dedup", drop_lines), ("order_minhash", keep_one), ("best_fit_packing", pack)]

#: Near-duplicate search and the genetic algorithm have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

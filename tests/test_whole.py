"""Queries over all rows, beside those whose SQL reads fewer."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tapewright.operators import simulate
from tapewright.plans import QUERIES
from tapewright.plans import simulation_queries as s
from tapewright.sources.market import trades

SMALL = "/root/testdata/sf0.001"


def test_resampled_matches_plain_draws(spark):
    rows = [("A", float(x)) for x in (3, 1, 2, 7)] + [("N", 5.0), ("N", 4.0)]
    want = []
    for by in ("A", "N"):
        own = sorted(x for b, x in rows if b == by)
        for sim in range(30):
            for step in range(len(own)):
                h = int(hashlib.md5(f"7/{by}/{sim}/{step}".encode()).hexdigest()[:12], 16)
                want.append((by, sim, step, own[h % len(own)]))
    got = simulate.resampled(spark.createDataFrame(rows, "strategy string, x double"), "x", "strategy", 30).collect()
    assert sorted(map(tuple, got)) == want


def test_whole_texts_and_lines_are_read(spark, tmp_path):
    rows = [(1, "x " * 150 + "gain", "en", 304), (2, "y" * 500 + "\nz", "fr", 502), (3, None, "en", 0), (4, "", "en", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = {r["doc_id"]: r["label"] for r in QUERIES["i03_whole_text_polarity"](spark, str(tmp_path)).collect()}
    assert labels == {1: "POSITIVE", 2: "NEUTRAL", 4: "NEUTRAL"}
    lines = {r["doc_id"]: r["headline"] for r in QUERIES["a23_all_headlines"](spark, str(tmp_path)).collect()}
    assert lines == {1: rows[0][1], 2: "y" * 500, 4: ""}


def test_whole_ledger_is_resampled(spark):
    t = trades(spark, SMALL)
    days = defaultdict(int, {r["strategy"]: r["n"] for r in t.groupBy("strategy").agg(F.count_distinct(F.to_date("exit_ts")).alias("n")).collect()})
    got = {r["strategy"]: r["n"] for r in s.every_day(spark, SMALL).groupBy("strategy").agg(F.count("*").alias("n")).collect()}
    assert got == dict(days) and min(days.values()) > 62
    whole = QUERIES["j10_bootstrap_whole"](spark, SMALL).collect()
    assert {r["strategy"] for r in whole} == set(days) and all(r["sims"] == 1000 for r in whole)
    assert {r["strategy"] for r in QUERIES["j11_permutation_whole"](spark, SMALL).collect()} == set(days)
    assert QUERIES["j12_bootstrap_difference_whole"](spark, SMALL).first()["sims"] == 1000

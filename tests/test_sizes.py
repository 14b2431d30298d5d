"""Work that was done a key, a pair or a value at a time is done in batches, with the same results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tapewright.operators import matching


def test_capped_open_takes_groups_in_batches(spark):
    """No call of Python a group; groups go on over batches, ends and starts may be missing, all columns pass."""
    rng = random.Random(5)
    rows = [(g, i, None if rng.random() < 0.1 else i + rng.randint(0, 9), f"{g}{i}") for g in (None, "a", "b", "c") for i in range(40)] + [("d", None, 5, "d0")]
    df = spark.createDataFrame(rows, "g string, a long, b long, x string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = matching.capped_open(df, "g", "a", "b", ["a"], 2)
        assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r["x"]: r["accepted"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held = {"d0": True}, {}
    for g, a, b, x in rows[:-1]:
        held[g] = [e for e in held.get(g, []) if e >= a]
        want[x] = len(held[g]) < 2
        if want[x] and b is not None:
            held[g].append(b)
    assert got == want


def test_implied_volatility_takes_a_batch_at_once(spark):
    """The volatility that a price was made with; none where something is missing; no fold over a sequence a row."""
    from tapewright.operators import scalars as s

    rows = [(100.0, 80.0 + 10 * i, 0.25 + 0.25 * i, 0.03, 0.15 + 0.05 * i) for i in range(5)] + [(100.0, None, 1.0, 0.03, 0.2)]
    df = spark.createDataFrame(rows, "s double, k double, t double, r double, sigma double")
    priced = df.withColumn("price", s.black_scholes_call(*map(F.col, ("s", "k", "t", "r", "sigma"))))
    out = priced.withColumn("found", s.implied_volatility(*map(F.col, ("price", "s", "k", "t", "r"))))
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        assert r["found"] == (None if r["k"] is None else pytest.approx(r["sigma"], abs=1e-5))


def test_boosting_counts_a_row_once_a_feature(spark):
    """Quantiles are counted together: a row makes a key a feature, and no text or structure a feature and quantile."""
    from tapewright.operators import boosting

    df = spark.range(400).selectExpr("id % 16 AS _bin_a", "id % 3 AS _bin_b", "cast(id % 16 > 7 AS double) AS _y", "0.5D AS q_10", "0.5D AS q_50", "0.5D AS q_90")
    seen, trees = [], {t: boosting.Tree() for t in (0.1, 0.5, 0.9)}
    made = type(df).collect
    spied = lambda self: seen.append(self.columns) or made(self)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(df), "collect", spied)
        boosting.grow(df, trees, ["a", "b"], 0, 20)
    assert seen == [["key", "n", "q_10", "q_50", "q_90"]]
    assert all(t.splits == {1: ("_bin_a", 7)} for t in trees.values())

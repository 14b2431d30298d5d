"""Neighbours from products of matrices: the same as all pairs one by one, whatever the vectors are."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import nearest


@pytest.mark.parametrize("metric", ["squared", "cosine"])
def test_neighbours_are_those_of_all_pairs(spark, monkeypatch, metric):
    """Copies, zero vectors, none at all, other lengths; queries in several blocks, rows and tiles in small ones."""
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(4)
    x = [v.tolist() for v in rng.normal(0, 1, (300, 5))]
    x += [x[3]] * 80 + [[2 * a for a in x[3]]] * 20 + [[0.0] * 5] * 30 + [None] * 25 + [[1.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, v array<double>").withColumn("label", F.col("vec_id") % 2).repartition(6)
    asked = df.where("vec_id % 20 = 3").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))

    def distance(a, b):
        if a is None or b is None or len(a) != len(b):
            return float("inf")
        if metric == "squared":
            return round(sum((p - q) ** 2 for p, q in zip(a, b, strict=True)), 9)
        n = np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
        return round(float(-np.dot(a, b) / n), 9) if n else float("inf")

    got = {}
    for r in nearest.neighbours(df, asked, 6, metric).collect():
        assert r["label"] == r["vec_id"] % 2
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["vec_id"])
    assert set(got) == {i for i in range(len(x)) if i % 20 == 3}
    for q, ranks in got.items():
        want = sorted((distance(x[q], v), i) for i, v in enumerate(x) if i != q)[:6]
        assert [(ranks[n][0] if ranks[n][0] is not None else float("inf"), ranks[n][1]) for n in range(1, 7)] == [(pytest.approx(d, abs=1e-8), i) for d, i in want], q


@pytest.mark.parametrize("name", ["k01_cosine_library", "k03_neighbour_veto", "k03_indexed_veto", "k04_local_win_chance"])
def test_no_pairs_in_the_plan(spark, name):
    """Pairs of rows and queries are made within tasks: the plan has no join, and what is shuffled are rows and the best of each task."""
    from tapewright.plans import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan

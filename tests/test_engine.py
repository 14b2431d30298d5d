"""Operators on awkward inputs, and those without SQL against plain versions of themselves."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions import scans
from tapewright.operators import asof, gates, matching, metrics, models, plugins, scalars, simulate
from tapewright.sources import ledgers

BARS = "symbol string, bar_no long, open double, high double, low double, close double, signal int, atr double"


def series(*closes, signal=None, atr=1.0, symbol="A"):
    signal = signal or {}
    return [(symbol, i, float(c), float(c) + 0.5, float(c) - 0.5, float(c), signal.get(i, 0), atr) for i, c in enumerate(closes, 1)]


def run(spark, rows, kernel, inputs):
    out = simulate.trades_of(spark.createDataFrame(rows, BARS), ["symbol"], inputs, kernel)
    return [tuple(r)[1:] for r in out.orderBy("symbol", "entry_bar").collect()]


OHLC = ["open", "high", "low", "close", "signal", "atr"]


def test_flat_series_makes_no_trades(spark):
    for kernel, inputs in ((simulate.bracket(), OHLC), (simulate.close_based(), ["open", "close", "signal", "atr"]), (simulate.limit_entry(), OHLC[1:]), (simulate.managed(), OHLC)):
        assert run(spark, series(*[10] * 30), kernel, inputs) == []
        assert run(spark, [], kernel, inputs) == []


def test_bracket_stops_first_and_fills_gaps_at_the_open(spark):
    rows = series(10, 10, 10, 5, 10, signal={2: 1})
    ((start, end, side, entry, at, why),) = run(spark, rows, simulate.bracket(slip=0.0), OHLC)
    assert (start, end, side, entry, at, why) == (2, 4, 1, 10.0, 5.0, "stop")
    ((*_, at, why),) = run(spark, rows, simulate.bracket(slip=0.0, gap="best"), OHLC)
    assert (at, why) == (8.5, "stop")
    ((*_, at, why),) = run(spark, series(10, 10, 10, 13, signal={2: 1}), simulate.bracket(slip=0.0), OHLC)
    assert (at, why) == (13.0, "target")
    assert run(spark, series(10, 10, 10, 10, signal={2: 1}), simulate.bracket(slip=0.0), OHLC) == []


def test_close_based_exits(spark):
    inputs = ["open", "close", "signal", "atr"]
    made = run(spark, series(*[10] * 4, 6, signal={1: 1}), simulate.close_based(), inputs)
    assert made == [(2, 5, 1, 10.0, 6.0, "stop")]
    made = run(spark, series(*[10] * 20, signal={1: 1}), simulate.close_based(hold=12), inputs)
    assert made == [(2, 14, 1, 10.0, 10.0, "time")]
    made = run(spark, series(*[10] * 8, signal={1: 1, 5: -1}), simulate.close_based(hold=50), inputs)
    assert made[0] == (2, 5, 1, 10.0, 10.0, "reversal")
    made = run(spark, series(10, 10, 15, 20, 16, signal={1: 1}), simulate.close_based(hold=50), inputs)
    assert made == [(2, 5, 1, 10.0, 16.0, "trail")]


def test_limit_entry_and_managed_trades(spark):
    made = run(spark, series(10, 9.6, 10.6, 11.6, 12, signal={1: 1}), simulate.limit_entry(), OHLC[1:])
    assert made == [(2, 4, 1, 9.5, (10.5 + 9.5 + 2) / 2, "target")]
    made = run(spark, series(10, 9.6, 9.6, 8, signal={1: 1}), simulate.limit_entry(), OHLC[1:])
    assert made == [(2, 4, 1, 9.5, 8.5, "stop")]
    assert run(spark, series(10, *[20] * 9, signal={1: 1}), simulate.limit_entry(), OHLC[1:]) == []
    made = run(spark, series(10, 11, 11.5, 9, signal={1: 1}), simulate.managed(), OHLC)
    assert made == [(1, 4, 1, 10.0, 11.0, "trail")]


def test_challenge_passes_breaks_and_stays_open():
    run_ = simulate.challenge()
    assert run_([1, 2], [5000.0, 4000.0])[0][0] == 2 and run_([1, 2], [5000.0, 4000.0])[0][3] == "pass"
    assert run_([1], [-5000.0])[0][3] == "bust" and run_([1], [10.0])[0][3] == "open"
    assert run_([1, 2, 3, 4], [3000.0, -3500.0, -3500.0, 0.0])[0][3] == "bust"


def test_capped_open_matches_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, i + rng.randint(0, 6)) for i in range(80)]
    out = matching.capped_open(spark.createDataFrame(rows, "g string, a long, b long"), "g", "a", "b", ["a"], 2)
    want = {}
    for g in "ab":
        taken = []
        for _, a, b in (r for r in rows if r[0] == g):
            want[a] = sum(x >= a for x in taken) < 2
            if want[a]:
                taken.append(b)
    assert {r["a"]: r["accepted"] for r in out.collect()} == want


def test_asof_directions_ties_and_missing(spark):
    left = spark.createDataFrame([("A", 1), ("A", 5), ("B", 5)], "s string, t long")
    right = spark.createDataFrame([("A", 2, 20.0), ("A", 5, 50.0), ("A", 9, None)], "s string, t long, v double")
    got = lambda **how: {(r["s"], r["t"]): r["v"] for r in asof.asof_join(left, right, "t", ["v"], ["s"], **how).collect()}
    assert got() == {("A", 1): None, ("A", 5): 50.0, ("B", 5): None}
    assert got(strict=True)[("A", 5)] == 20.0
    assert got(forward=True) == {("A", 1): 20.0, ("A", 5): 50.0, ("B", 5): None}
    assert asof.asof_join(left.where("false"), right, "t", ["v"], ["s"]).isEmpty()


def test_overlaps_match_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, a, a + rng.randint(0, 5)) for i, a in enumerate(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "s string, i long, a long, b long")
    for r in asof.overlap_counts(df, ["s"], "a", "b").collect():
        assert r["n_overlaps"] == sum(x[0] == r["s"] and x[2] <= r["b"] and r["a"] <= x[3] for x in rows)


def test_rules_are_only_expressions_over_columns(spark):
    df = spark.createDataFrame([(1, "a"), (5, "b")], "x int, s string")
    assert df.where(gates.rule(df, "x > 2 and (s = 'b' or not x in (1, 2))")).count() == 1
    for bad in ("exec(x)", "x; drop", "java_method('a')", "y > 1", "x > (select 1)", "s rlike 'a'"):
        with pytest.raises(ValueError):
            gates.rule(df, bad)


def test_scans_match_pandas():
    import pandas as pd

    x = np.array([np.nan, 1, 4, np.nan, 2, 8, 5.5, 3])
    for adjust in (False, True):
        want = pd.Series(x).ewm(alpha=0.3, adjust=adjust, min_periods=2).mean().to_numpy()
        assert np.allclose(scans.ewm(x, 0.3, adjust, 2), want, equal_nan=True)


def test_normal_formulas(spark):
    normal = statistics.NormalDist()
    xs = [-3.0, -1.0, 0.0, 0.4, 2.5]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalars.normal_cdf(F.col("x")).alias("p")).collect():
        assert abs(r["p"] - normal.cdf(r["x"])) < 1e-6
    for r in spark.createDataFrame([(p,) for p in (0.01, 0.3, 0.5, 0.9)], "p double").select("p", scalars.normal_quantile(F.col("p")).alias("x")).collect():
        assert abs(r["x"] - normal.inv_cdf(r["p"])) < 1e-3
    row = spark.range(1).select(*(c.alias(n) for n, c in zip("ab", scalars.deflated_sharpe(F.lit(0.2), F.lit(10), F.lit(0.1), F.lit(200)), strict=True))).first()
    g = 0.5772156649
    hurdle = 0.1 * ((1 - g) * normal.inv_cdf(0.9) + g * normal.inv_cdf(1 - 1 / (10 * math.e)))
    assert abs(row["a"] - hurdle) < 1e-3 and abs(row["b"] - normal.cdf((0.2 - hurdle) * math.sqrt(199) / math.sqrt(1.02))) < 1e-2


def test_kmeans_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    centres, out = models.kmeans(df, ["a", "b"], 3)
    c = x[[0, 40, 80]]
    for _ in range(10):
        near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.stack([x[near == k].mean(0) for k in range(3)])
    assert np.allclose(centres, c) and [r["cluster"] for r in out.orderBy("id").collect()] == near.tolist()


def test_small_problems():
    p, k = models.riccati(np.array([[1.0]]), np.array([[1.0]]), np.eye(1), np.eye(1))
    assert abs(p[0, 0] - (1 + math.sqrt(5)) / 2) < 1e-9 and abs(k[0, 0] - p[0, 0] / (1 + p[0, 0])) < 1e-9
    value, best = models.value_iteration({("s", "stay", "s"): (1, 1.0), ("s", "go", "t"): (1, 5.0), ("t", "stay", "t"): (1, 0.0)})
    assert best == {"s": "stay", "t": "stay"} and abs(value["s"] - 10) < 1e-6
    clean = models.clean_correlation(np.array([[1.0, 0.1], [0.1, 1.0]]), 0.5)
    assert np.allclose(np.diag(clean), 1) and abs(clean[0, 1]) < 1e-9


def test_kalman_follows_a_line():
    y = 2.0 * np.arange(200) + 1
    out = models.kalman()({"close": y})
    assert abs(out["slope"][-1] - 2) < 1e-3 and abs(out["level"][-1] - y[-1]) < 1e-2


def test_measures_on_empty_and_equal_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None)], "g string, x double")
    rows = {r["g"]: r for r in df.groupBy("g").agg(metrics.sharpe("x").alias("s"), metrics.profit_factor("x", 999.0).alias("p"), metrics.correlation("x", "x").alias("c")).collect()}
    assert rows["a"]["s"] is None and rows["a"]["p"] == 999.0 and rows["a"]["c"] is None and rows["b"]["s"] is None
    assert metrics.summary(df.where("false"), ["g"], "x").isEmpty()


def test_ledgers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "y": "a"}\nnot json\n{"x": 2}\n{"x": ')
    rows = ledgers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int, y string").collect()
    assert sorted((r["x"], r["y"]) for r in rows) == [(1, "a"), (2, None)]
    (tmp_path / "a.csv").write_text("x,z\n1,2\nbad,3\n")
    assert [tuple(r) for r in ledgers.read_csv(spark, str(tmp_path / "a.csv"), "x int, w string", ["x"]).collect()] == [(1, None), (None, None)]
    with pytest.raises(ValueError, match="lacks"):
        ledgers.read_csv(spark, str(tmp_path / "a.csv"), "x int", ["q"])


def test_plug_ins(spark):
    df = spark.createDataFrame([("A", i, float(i)) for i in range(1, 8)], "symbol string, bar_no long, close double")
    out = plugins.rolling_apply(df, "close", 3, np.ptp, "spread").orderBy("bar_no").collect()
    assert [r["spread"] for r in out] == [None, None] + [2.0] * 5
    with pytest.raises(ValueError, match="not open"):
        plugins.experiment(df, {"a": 1}, {"b": 2}, lambda d, c: d, ["symbol"], ["a"])


def test_results_do_not_depend_on_partitions(spark):
    from tapewright.functions import indicators as ind

    rng = random.Random(9)
    rows = [("AB"[i % 2], i // 2 + 1, *(lambda o, c: (o, max(o, c) + 1, min(o, c) - 1, c))(rng.random() * 10 + 20, rng.random() * 10 + 20), float(i)) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, bar_no long, open double, high double, low double, close double, volume double")
    for f in (ind.rsi, ind.adx, ind.aroon, ind.supertrend, ind.order_block_state):
        a, b = (sorted(map(tuple, f(df.repartition(n)).collect()), key=str) for n in (1, 7))
        assert a == b
        assert f(df.where("false")).isEmpty()
        assert f(df.where("bar_no = 1")).count() == 2

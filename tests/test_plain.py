"""Queries that have no SQL, against plain versions on the smallest tables."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import blocks, models, simulate
from tapewright.plans import QUERIES, SQL
from tapewright.plans import model_queries as mq
from tapewright.plans.simulation_queries import signals
from tapewright.sources.market import bars, trades

SMALL = "/root/testdata/sf0.001"


def answer(spark, name):
    return QUERIES[name](spark, SMALL).collect()


@pytest.fixture(scope="module")
def series(spark):
    """Bars by symbol, in order."""
    out = defaultdict(list)
    for r in bars(spark, SMALL).orderBy("symbol", "bar_no").collect():
        out[r["symbol"]].append(r)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return mq.labelled(spark, SMALL).orderBy("symbol", "bar_no").collect()


def test_all_queries_without_sql_are_tested_somewhere():
    tested = {
        *("c18_correlation_cap", "j04_limit_entry", "j08_challenge", "k02_kmeans", "k07_kalman", "k08_regulator", "k09_value_iteration"),  # test_engine
        *("f55_two_regimes", "f57_logistic_fit", "k11_independent_components", "k11_mahalanobis", "k14_boosted_quantiles", "k07_factor_filter", "k10_policy_gradient", "k17_halving"),  # test_learners
        *("f70_level_clusters", "i28_deflated_sharpe", "j13_random_sweep", "k14_quantile_regression", "k05_logistic", "k05_softmax", "k11_principal_components", "k15_boosted_trees", "k16_isotonic", "k17_grid_search", "k20_tree_rules", "k21_clean_portfolio", "k22_look_ahead"),
    }
    assert set(QUERIES) - set(SQL) == tested


# --- ranges


@pytest.fixture(scope="module")
def long_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(60), i, None if rng.random() < 0.4 else rng.randrange(100)) for i in range(400)]
    return rows, spark.createDataFrame(rows, "k string, t long, i long, x long").repartition(7)


def test_running_sums_over_ranges(long_rows):
    rows, df = long_rows
    by_row = {r["i"]: r["s"] for r in blocks.running_sums(df, ["k"], ["t", "i"], {"s": F.coalesce("x", F.lit(0))}).collect()}
    by_peer = {r["i"]: r["s"] for r in blocks.running_sums(df, [], ["t"], {"s": F.coalesce("x", F.lit(0))}, peers=True).collect()}
    for k, t, i, _ in rows:
        assert by_row[i] == sum(x or 0 for k2, t2, i2, x in rows if k2 == k and (t2, i2) <= (t, i))
        assert by_peer[i] == sum(x or 0 for _, t2, _, x in rows if t2 <= t)


def test_neighbours_and_last_seen_over_ranges(long_rows):
    rows, df = long_rows
    ordered = {k: sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]) for k in "ab"}
    before = {r["i"]: r["y"] for r in blocks.neighbour(df, ["k"], ["t", "i"], "x", "y").collect()}
    after = {r["i"]: r["y"] for r in blocks.neighbour(df, ["k"], ["t", "i"], "x", "y", ahead=True).collect()}
    seen = {r["i"]: r["x"] for r in blocks.last_seen(df, ["k"], ["t", "i"], ["x"]).collect()}
    coming = {r["i"]: r["x"] for r in blocks.last_seen(df, ["k"], ["t", "i"], ["x"], backward=True).collect()}
    for own in ordered.values():
        for n, r in enumerate(own):
            assert before[r[2]] == (own[n - 1][3] if n else None) and after[r[2]] == (own[n + 1][3] if n + 1 < len(own) else None)
            assert seen[r[2]] == next((x[3] for x in reversed(own[: n + 1]) if x[3] is not None), None)
            assert coming[r[2]] == next((x[3] for x in own[n:] if x[3] is not None), None)
    assert [r["i"] for r in blocks.rows_at(df, "i", [0, 133, 399, 400])] == [0, 133, 399]
    assert blocks.neighbour(df.where("false"), ["k"], ["t"], "x", "y").isEmpty() and blocks.rows_at(df.where("false"), "i", [0]) == []


# --- levels, ratios, sweeps


def test_level_clusters(spark, series):
    from tapewright.functions import indicators as ind

    swings = defaultdict(list)
    for r in ind.swing_points(bars(spark, SMALL)).where("state = 1").orderBy("symbol", "bar_no").collect():
        swings[r["symbol"]].append(r["raw"])
    want = []
    for symbol, prices in swings.items():
        groups = []
        for p in prices:
            for g in groups:
                if abs(p - g[0]) <= 0.01 * g[0]:
                    g.append(p)
                    break
            else:
                groups.append([p])
        want += [(symbol, round(sum(g) / len(g), 6), len(g)) for g in groups if len(g) > 1]
    assert sorted(map(tuple, answer(spark, "f70_level_clusters"))) == sorted(want)


def test_deflated_sharpe(spark):
    from statistics import NormalDist

    got = {(r["strategy"], r["regime"]): r for r in answer(spark, "i28_deflated_sharpe")}
    cells = defaultdict(list)
    for r in trades(spark, SMALL).collect():
        cells[r["strategy"], r["regime"]].append(r["r"])
    ratio = {k: np.mean(v) / np.std(v, ddof=1) for k, v in cells.items()}
    n, spread, normal, euler = len(ratio), np.std(list(ratio.values()), ddof=1), NormalDist(), 0.5772156649
    hurdle = spread * ((1 - euler) * normal.inv_cdf(1 - 1 / n) + euler * normal.inv_cdf(1 - 1 / (n * math.e)))
    for k, s in ratio.items():
        assert abs(got[k]["sharpe"] - s) < 1e-5 and abs(got[k]["hurdle"] - hurdle) < 5e-4
        assert (got[k]["chance"] > 0.5) == (s > got[k]["hurdle"])


def test_random_sweep_matches_single_backtests(spark, series):
    made = answer(spark, "j13_random_sweep")
    rng = random.Random(2)
    by = defaultdict(list)
    for r in signals(spark, SMALL).orderBy("bar_no").collect():
        by[r["symbol"]].append(r)
    for r in rng.sample(made, 25):
        own = by[r["symbol"]]
        arrays = [np.array([x[c] for x in own], dtype=float) for c in ("bar_no", "open", "high", "low", "close", "signal", "atr")]
        rets = [(out / entry - 1) * side for _, _, side, entry, out, _ in simulate.bracket(stop_mult=r["stop_mult"], reward=r["reward"])(*arrays)]
        assert r["n"] == len(rets) and abs(r["total"] - sum(rets)) < 1e-5 and abs(r["win_rate"] - np.mean([x > 0 for x in rets])) < 1e-5
    assert len({(r["stop_mult"], r["reward"]) for r in made}) > 1500


def test_grid_search_takes_the_best_of_all(spark):
    by = defaultdict(list)
    for r in signals(spark, SMALL).orderBy("bar_no").collect():
        by[r["symbol"]].append(r)
    for r in answer(spark, "k17_grid_search"):
        own = by[r["symbol"]]
        cut = 0.6 * max(x["bar_no"] for x in own)
        arrays = [np.array([x[c] for x in own], dtype=float) for c in ("bar_no", "open", "high", "low", "close", "signal", "atr")]
        fits = {}
        for stop in np.linspace(0.5, 3, 6):
            for reward in np.linspace(1, 4, 7):
                made = simulate.bracket(stop_mult=stop, reward=reward)(*arrays)
                if made:
                    fits[stop, reward] = sum((x / e - 1) * s for _, end, s, e, x, _ in made if end <= cut)
        best = max(fits, key=lambda k: (fits[k], -k[0], -k[1]))
        assert abs(r["fit"] - fits[best]) < 1e-5 and abs(fits[r["stop_mult"], r["reward"]] - fits[best]) < 1e-9


# --- estimators


def parts(rows, upto=0.6, until=1.0):
    """Indices of rows before the share of each series, and of those after it with a gap of five bars."""
    ends = defaultdict(int)
    for r in rows:
        if r["place"] < upto:
            ends[r["symbol"]] = max(ends[r["symbol"]], r["bar_no"])
    train = [i for i, r in enumerate(rows) if r["place"] < upto]
    return train, [i for i, r in enumerate(rows) if r["bar_no"] - ends[r["symbol"]] > 5 and r["place"] < until and ends[r["symbol"]]]


def standard(rows, train):
    x = np.array([r["features"].toArray() for r in rows])
    sd = x[train].std(0, ddof=1)
    return (x - x[train].mean(0)) / sd


def accuracy_by_symbol(rows, test, right):
    out = defaultdict(list)
    for i, ok in zip(test, right, strict=True):
        out[rows[i]["symbol"]].append(ok)
    return {k: (len(v), float(np.mean(v))) for k, v in out.items()}


def test_logistic_matches_newton(spark, rows):
    train, test = parts(rows)
    x = np.column_stack([standard(rows, train), np.ones(len(rows))])
    y = np.array([r["label"] for r in rows])
    w, ridge = np.zeros(5), np.diag([0.01] * 4 + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x[train] @ w))
        w -= np.linalg.solve((x[train] * (p * (1 - p))[:, None]).T @ x[train] / len(train) + ridge, x[train].T @ (p - y[train]) / len(train) + ridge @ w)
    want = accuracy_by_symbol(rows, test, (x[test] @ w > 0) == (y[test] == 1))
    got = {r["symbol"]: (r["n"], r["accuracy"]) for r in answer(spark, "k05_logistic")}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) <= 0.02 for k in want)


def test_softmax_beats_guessing(spark, rows):
    train, test = parts(rows)
    gain = np.array([r["later"] / r["close"] - 1 for r in rows])
    y = np.where(gain > 0.005, 2, np.where(gain < -0.005, 0, 1))
    x = np.column_stack([standard(rows, train), np.ones(len(rows))])
    w, hot = np.zeros((5, 3)), np.eye(3)[y]
    for _ in range(4000):
        z = x[train] @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 0.5 * (x[train].T @ (p - hot[train]) / len(train) + np.vstack([0.01 * w[:4], np.zeros((1, 3))]))
    want = accuracy_by_symbol(rows, test, (x[test] @ w).argmax(1) == y[test])
    got = {r["symbol"]: (r["n"], r["accuracy"]) for r in answer(spark, "k05_softmax")}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) <= 0.03 for k in want)


def test_principal_components_match_svd(spark):
    x = np.array([r["v"] for r in mq.vectors(spark, SMALL).collect()])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    got = [r["share"] for r in sorted(answer(spark, "k11_principal_components"), key=lambda r: r["component"])]
    assert np.allclose(got, s[:4] / s.sum(), atol=2e-6)


def pooled(x, y):
    """Isotonic means by pooling neighbours; equal x are one point."""
    by = defaultdict(list)
    for a, b in zip(x, y, strict=True):
        by[a].append(b)
    stack = []
    for a in sorted(by):
        stack.append([sum(by[a]), len(by[a]), [a]])
        while len(stack) > 1 and stack[-2][0] / stack[-2][1] >= stack[-1][0] / stack[-1][1]:
            s, n, xs = stack.pop()
            stack[-1] = [stack[-1][0] + s, stack[-1][1] + n, stack[-1][2] + xs]
    return [a for _, _, xs in stack for a in xs], [s / n for s, n, xs in stack for _ in xs]


def test_isotonic_folds_match_pooling(spark, rows):
    got = {r["fold"]: r for r in answer(spark, "k16_isotonic")}
    assert sorted(got) == [1, 2, 3, 4, 5]
    for fold in got:
        train, test = parts(rows, fold / 6, (fold + 1) / 6)
        xs, ys = pooled([rows[i]["rsi"] / 100 for i in train], [rows[i]["label"] for i in train])
        p = np.interp([rows[i]["rsi"] / 100 for i in test], xs, ys)
        brier = np.mean((p - [rows[i]["label"] for i in test]) ** 2)
        assert got[fold]["n"] == len(test) and abs(got[fold]["brier"] - brier) < 2e-3
    assert max(r["place"] for r in rows) > 0.95 and sum(r["n"] for r in got.values()) > 0.6 * len(rows)


def test_trees(spark, rows):
    train, test = parts(rows)
    y = np.array([r["label"] for r in rows])
    leaves = answer(spark, "k20_tree_rules")
    assert sum(r["n"] for r in leaves) == len(test)
    assert abs(sum(r["n"] * r["rate"] for r in leaves) - y[test].sum()) < 1e-3 * len(test)
    correct = sum(r["n"] * (r["rate"] if r["prediction"] == 1 else 1 - r["rate"]) for r in leaves) / len(test)
    boosted = answer(spark, "k15_boosted_trees")
    assert sum(r["n"] for r in boosted) == len(test)
    guess = max(y[test].mean(), 1 - y[test].mean())
    assert correct > guess and sum(r["n"] * r["accuracy"] for r in boosted) / len(test) > guess


def test_clean_portfolio(spark, series):
    names = sorted(series)
    rets = {s: {b["ts"]: b["close"] / a["close"] - 1 for a, b in zip(series[s], series[s][1:], strict=False)} for s in names}
    k = len(names)
    corr, most = np.eye(k), 0
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = sorted(rets[a].keys() & rets[b].keys())
            most = max(most, len(both))
            if i != j and len(both) > 1:
                corr[i, j] = np.corrcoef([rets[a][t] for t in both], [rets[b][t] for t in both])[0, 1]
    mu, sd = (np.array([f(list(rets[s].values())) for s in names]) for f in (np.mean, lambda v: np.std(v, ddof=1)))
    weights = np.clip(np.linalg.solve(models.clean_correlation((corr + corr.T) / 2, k / most) * np.outer(sd, sd), mu), -1, 1)
    got = {r["symbol"]: r["weight"] for r in answer(spark, "k21_clean_portfolio")}
    assert np.allclose([got[s] for s in names], weights, atol=1e-5)


def test_only_centred_indicators_look_ahead(spark):
    made = answer(spark, "k22_look_ahead")
    assert {r["cut"] for r in made} == set(range(1, 11)) and len({r["indicator"] for r in made}) == 7
    assert all(r["differ"] == 0 for r in made if r["indicator"] != "swing_points")
    assert any(r["differ"] for r in made if r["indicator"] == "swing_points" and r["cut"] < 10)
    assert all(r["differ"] == 0 for r in made if r["cut"] == 10)


def test_correlation_cap_matches_a_loop(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").selectExpr("o_custkey", "o_orderkey", "o_orderdate AS entry", "o_orderdate + make_interval(0, 0, 0, cast(30 + o_orderkey % 60 as int)) AS exit").collect()
    want = {}
    by = defaultdict(list)
    for r in sorted(orders, key=lambda r: (r["entry"], r["o_orderkey"])):
        held = [e for e in by[r["o_custkey"]] if e > r["entry"]]
        want[r["o_orderkey"]] = len(held) < 2
        by[r["o_custkey"]] = held + [r["exit"]] if len(held) < 2 else held
    got = QUERIES["c18_correlation_cap"](spark, SMALL)
    flag = next(c for c, t in got.dtypes if t == "boolean")
    assert {r["o_orderkey"]: r[flag] for r in got.collect()} == want


def test_quantile_lines_split_the_rows_and_lose_little(spark):
    by = defaultdict(list)
    for r in trades(spark, SMALL).collect():
        by[r["strategy"]].append((r["quantity"], r["r"]))
    made = answer(spark, "k14_quantile_regression")
    assert len(made) == 3 * len(by)
    for r in made:
        x, y = np.array(by[r["strategy"]]).T
        loss = lambda a, b, t=r["tau"], x=x, y=y: np.where((e := y - a - b * x) > 0, t * e, (t - 1) * e).mean()
        own = loss(r["intercept"], r["slope"])
        e = y - r["intercept"] - r["slope"] * x
        assert (e < -1e-3).mean() <= r["tau"] + 0.03 and (e <= 1e-3).mean() >= r["tau"] - 0.03  # results come in steps
        for da in (-0.05, 0, 0.05):
            for db in (-0.003, 0, 0.003):
                assert own <= loss(r["intercept"] + da, r["slope"] + db) + 2e-4

"""Components, boosted quantiles and models of rolling windows, against plain versions."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import boosting, components, models, rolling
from tapewright.plans import QUERIES
from tapewright.plans import model_queries as mq

SMALL = "/root/testdata/sf0.001"


# --- components


def plain_components(x, k, rounds=40, tolerance=1e-4, seed=42):
    mean = x.mean(0)
    values, directions = np.linalg.eigh(np.cov(x.T, bias=True))
    order = np.argsort(-values)[:k]
    white = directions[:, order].T / np.sqrt(values[order])[:, None]
    z = (x - mean) @ white.T
    rng = np.random.default_rng(seed)
    found = []
    for c in range(k):
        def away(w):
            for o in found:
                w = w - (w @ o) * o
            return w / np.linalg.norm(w)

        w = away(rng.standard_normal(k))
        for _ in range(rounds if c + 1 < k else 0):
            g = np.tanh(z @ w)
            new = away((z * g[:, None]).mean(0) - (1 - g**2).mean() * w)
            done = abs(abs(new @ w) - 1) < tolerance
            w = new
            if done:
                break
        found.append(w if w[np.argmax(np.abs(w))] > 0 else -w)
    return z @ np.array(found).T


def test_components_are_those_of_a_plain_version_and_unrelated(spark):
    x = np.array([r["v"] for r in mq.vectors(spark, SMALL).orderBy("vec_id").collect()])
    got = np.array([r[1:] for r in QUERIES["k11_independent_components"](spark, SMALL).orderBy("vec_id").collect()])
    want = plain_components(x, 4)
    assert np.abs(np.abs(got) - np.abs(want)).max() < 0.02
    off = np.corrcoef(got.T)[~np.eye(4, dtype=bool)]
    assert np.abs(off).mean() < 0.05
    far = {r["vec_id"]: r["distance"] for r in QUERIES["k11_mahalanobis"](spark, SMALL).collect()}
    c = x - x.mean(0)
    plain = np.sqrt(np.einsum("ni,ij,nj->n", c, np.linalg.pinv(np.cov(x.T, bias=True)), c))
    assert np.abs(np.array([far[i] for i in sorted(far)]) - plain).max() < 1e-3


def test_mixed_sources_come_apart(spark):
    rng = np.random.default_rng(1)
    s = np.stack([np.sign(rng.standard_normal(2000)) + 0.1 * rng.standard_normal(2000), rng.uniform(-1, 1, 2000), rng.laplace(size=2000)], 1)
    x = s @ rng.standard_normal((3, 3)) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id long, v array<double>")
    mean, matrix = components.independent(df, "v", 3)
    found = (x - mean) @ matrix.T
    match = np.abs(np.corrcoef(s.T, found.T)[:3, 3:])
    assert (match.max(1) > 0.98).all() and sorted(match.argmax(1)) == [0, 1, 2]
    assert components.distances(df, "v", "d").where("id = -1").first()["d"] is None
    assert components.distances(df.where("false"), "v", "d").isEmpty()


# --- quantiles


def test_boosted_quantiles_have_less_loss_than_lines(spark):
    rows = mq.ledger_features(spark, SMALL).cache()
    early, late = rows.where("not late"), rows.where("late")
    taus = [0.1, 0.5, 0.9]
    made = boosting.fit_quantiles(early, mq.BOOSTED, "result", taus, rounds=8).predict(late)
    lines = models.quantile_lines(early, "quantity", "result", ["strategy"], taus)
    loss = made.agg(*(F.avg(boosting.pinball(F.col("result"), F.col(boosting.name(t)), t)).alias(f"t{round(t * 100)}") for t in taus)).first()
    q = F.col("intercept") + F.col("slope") * F.col("quantity")
    of_lines = {r["tau"]: r["loss"] for r in late.join(lines, "strategy").groupBy("tau").agg(F.avg(F.when(F.col("result") >= q, F.col("tau") * (F.col("result") - q)).otherwise((1 - F.col("tau")) * (q - F.col("result")))).alias("loss")).collect()}
    got = {t: loss[f"t{round(t * 100)}"] for t in taus}
    assert sum(got.values()) < sum(of_lines.values()) and all(got[t] < of_lines[t] for t in taus)
    rows.unpersist()


def test_a_step_is_found_at_every_quantile(spark):
    rng = np.random.default_rng(3)
    x, z = rng.uniform(0, 1, 3000), rng.uniform(0, 1, 3000)
    y = np.where(x > 0.5, 10, 0) + rng.uniform(0, 1, 3000) * np.where(z > 0.5, 4, 1)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, z, y, strict=True)] + [(None, 0.1, 0.5), (0.1, 0.1, None)], "x double, z double, y double")
    model = boosting.fit_quantiles(df, ["x", "z"], "y", [0.2, 0.8], rounds=20, rate=0.4)
    rows = model.predict(df.where("y is not null")).groupBy((F.coalesce("x", F.lit(0.0)) > 0.5).alias("high"), (F.col("z") > 0.5).alias("wide")).agg(F.avg("q_20").alias("a"), F.avg("q_80").alias("b")).collect()
    for r in rows:
        wide = 4 if r["wide"] else 1
        assert abs(r["a"] - (10 * r["high"] + 0.2 * wide)) < 0.5 and abs(r["b"] - (10 * r["high"] + 0.8 * wide)) < 0.5


# --- rolling windows


def plain_states(x, start, rounds):
    """Two states of one window [bar, feature], in loops."""
    mean, var, move, begin = (np.array(p) for p in start)
    for _ in range(rounds):
        like = np.array([[math.exp(sum(-0.5 * ((f - m) ** 2 / v + math.log(2 * math.pi * v)) for f, m, v in zip(row, mean[k], var[k], strict=True))) for k in (0, 1)] for row in x])
        ahead = np.zeros_like(like)
        p = begin * like[0]
        ahead[0] = p / p.sum()
        for i in range(1, len(x)):
            p = (ahead[i - 1] @ move) * like[i]
            ahead[i] = p / p.sum()
        back = np.ones_like(like)
        moves = np.full((2, 2), 1e-6)
        for i in range(len(x) - 2, -1, -1):
            pair = ahead[i][:, None] * move * (like[i + 1] * back[i + 1])[None]
            moves += pair / pair.sum()
            b = move @ (like[i + 1] * back[i + 1])
            back[i] = b / b.sum()
        g = ahead * back
        g /= g.sum(1, keepdims=True)
        w = g.sum(0)[:, None] + 1e-10
        mean = g.T @ x / w
        var = np.maximum(np.stack([(g[:, k : k + 1] * (x - mean[k]) ** 2).sum(0) for k in (0, 1)]) / w, 1e-3)
        move, begin = moves / moves.sum(1, keepdims=True), g[0]
    return mean, var, move, begin


def test_regimes_are_those_of_a_plain_fit():
    rng = np.random.default_rng(5)
    wild = np.repeat([0, 1, 0, 1], 40)
    r = rng.normal(0, np.where(wild, 0.05, 0.005))
    x = np.stack([r, np.abs(r), rng.normal(0, 1, 160) * (1 + wild)], 1)
    windows = np.full((40, 100, 3), np.nan)
    for k in range(40):
        end = 50 + k * 2 + (30 if k > 20 else 0)
        n = min(end, 100)
        windows[k, 100 - n :] = x[end - n : end]
    got = rolling.regimes(20, 5)(windows, None)
    scaled = []
    for w in windows:
        own = w[~np.isnan(w[:, 0])]
        scaled.append((own - own.mean(0)) / np.maximum(own.std(0), 1e-12))
    last = scaled[-1]
    part = last[:, 1] > np.median(last[:, 1])
    start = (np.stack([last[~part].mean(0), last[part].mean(0)]), np.maximum(np.stack([last[~part].var(0), last[part].var(0)]), 1e-3), [[0.9, 0.1], [0.1, 0.9]], [0.5, 0.5])
    first = plain_states(last, start, 20)
    for k in (0, 7, 25, 39):
        mean, var, move, begin = plain_states(scaled[k], first, 5)
        logs = np.stack([-0.5 * ((scaled[k] - mean[s]) ** 2 / var[s] + np.log(2 * np.pi * var[s])).sum(1) for s in (0, 1)], 1)
        way = np.log(begin + 1e-300) + logs[0]
        for row in logs[1:]:
            way = (way[:, None] + np.log(move)).max(0) + row
        s = int(way.argmax())
        assert abs(got["leave"][k] - (1 - move[s, s])) < 1e-6 and got["state"][k] == float(s != mean[:, 1].argmin())
    ends = [50 + k * 2 + (30 if k > 20 else 0) for k in range(40)]
    assert np.mean([g == wild[e - 1] for g, e in zip(got["state"], ends, strict=True)]) > 0.85


@pytest.mark.parametrize("piece", [7, 64, 1000])
def test_windows_do_not_depend_on_pieces(spark, piece):
    rows = [(s, i, float((i * 7 + len(s)) % 11)) for s, n in (("a", 50), ("bb", 9), ("c", 1)) for i in range(1, n + 1)]
    fit = lambda x, n: {"total": np.nansum(x[:, :, 0], 1), "n": n.astype(float), "none": np.where(n < 5, np.nan, 1.0)}
    df = spark.createDataFrame(rows, "symbol string, bar_no long, v double").repartition(3)
    got = {(r[0], r[1]): tuple(r[2:]) for r in rolling.by_windows(df, ["v"], ["total", "n", "none"], 5, fit, piece=piece, first=3, step=2).collect()}
    by = defaultdict(list)
    for s, _, v in rows:
        by[s].append(v)
    assert got == {(s, b): (sum(v[max(0, b - 5) : b]), min(b, 5), 1.0 if b >= 5 else None) for s, v in by.items() for b in range(3, len(v) + 1, 2)}


def test_growth_curves_are_found():
    rng = np.random.default_rng(9)
    t = np.arange(40.0)
    true = [(rng.uniform(0.15, 1.2), rng.uniform(10, 30), rng.uniform(0.8, 1.5)) for _ in range(30)]
    clean = np.array([v / (1 + np.exp(-k * (t - m))) for k, m, v in true])
    low, span = clean.min(1), np.ptp(clean, axis=1)
    p, r2 = rolling.logistic_fits(clean)
    assert (r2 > 0.995).all()
    noisy = (clean - low[:, None]) / span[:, None] + rng.normal(0, 0.05, clean.shape)
    p, r2 = rolling.logistic_fits(noisy)
    for row, fitted in zip(noisy, p, strict=True):
        v = (row - row.min()) / np.ptp(row)
        best = None
        centre, width = np.array([0.6, 20.0, 1.2]), np.array([0.6, 20.0, 0.8])
        for _ in range(14):  # a plain search on ever finer grids, around the best so far
            grid = [np.clip(np.linspace(c - w, c + w, 13), lo, hi) for c, w, lo, hi in zip(centre, width, (0.001, 0, 0.5), (2.0, 40.0, 2.0), strict=True)]
            k, m, top = (a.ravel() for a in np.meshgrid(*grid, indexing="ij"))
            e = ((top[:, None] / (1 + np.exp(-k[:, None] * (t - m[:, None]))) - v) ** 2).sum(1)
            at = e.argmin()
            best, centre, width = e[at], np.array([k[at], m[at], top[at]]), width * 0.5
        error = ((fitted[2] / (1 + np.exp(-fitted[0] * (t - fitted[1]))) - v) ** 2).sum()
        assert error <= best + 1e-6 and abs(fitted[0] - centre[0]) < 2e-3
    flat, none = rolling.logistic_fits(np.ones((2, 40)))
    assert np.isnan(flat).all() and np.isnan(none).all()


def test_window_queries(spark):
    got = QUERIES["f55_two_regimes"](spark, SMALL).collect()
    assert got and {r["wild"] for r in got} == {0, 1} and all(r["since"] >= 0 for r in got)
    fitted = QUERIES["f57_logistic_fit"](spark, SMALL).where("r2 > 0.3").collect()
    assert fitted and all(0.001 <= r["rate"] <= 2 for r in fitted)


# --- searches, filters and order statistics


def test_quantiles_of_groups_by_ranges(spark):
    from tapewright.operators import order_stats

    rng = np.random.default_rng(4)
    values = {"a": rng.normal(0, 1, 3000), "b": rng.integers(0, 4, 500).astype(float), "c": np.array([2.5]), "d": np.array([1.0, 4.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), (None, 7.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    shares = {"low": 0.05, "mid": 0.5, "high": 0.973, "least": 0.0, "most": 1.0}
    got = {r["k"]: r for r in order_stats.quantiles(df.where("k is not null"), "x", ["k"], shares).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        for n, p in shares.items():
            assert got[k][n] == pytest.approx(np.quantile(v, p), abs=1e-12)
    whole = order_stats.quantiles(df, "x", [], {"q": 0.25}).first()["q"]
    assert whole == pytest.approx(np.quantile([x for _, x in rows if x is not None], 0.25), abs=1e-12)
    assert order_stats.quantiles(df.where("false"), "x", ["k"], shares).isEmpty()


def test_policy_goes_where_rewards_are(spark):
    from tapewright.operators import policy

    rng = np.random.default_rng(7)
    a = rng.uniform(0, 1, (4000, 2))
    r = -((a[:, 0] - 0.8) ** 2) - 2 * (a[:, 1] - 0.3) ** 2 + rng.normal(0, 0.05, 4000)
    df = spark.createDataFrame([(*map(float, x), float(y)) for x, y in zip(a, r, strict=True)] + [(0.5, None, 1.0)], "u double, v double, r double")
    got = policy.learn(df, ["u", "v"], "r", steps=25)
    mean, push, sigma = np.array([0.5, 0.5]), np.zeros(2), 0.2
    for t, step in enumerate(got):
        w = np.exp(-((a - mean) ** 2).sum(1) / (2 * sigma**2))
        value = (w * r).sum() / w.sum()
        assert np.allclose(step.mean, mean, atol=1e-9) and step.value == pytest.approx(value, abs=1e-9)
        gradient = (w[:, None] * (a - mean) * (r - value)[:, None]).sum(0) / w.sum() / sigma**2
        push = 0.8 * push + 0.2 * np.clip(gradient, -0.5, 0.5)
        mean = np.clip(mean + 0.05 / math.sqrt(1 + t / 10) * push * 10, 0, 1)
        sigma = max(0.05, sigma * 0.99)
    assert got[-1].value > got[0].value + 0.1 and got[-1].mean[0] > 0.7 and got[-1].mean[1] < 0.4
    ledger = QUERIES["k10_policy_gradient"](spark, SMALL).first()
    assert ledger["learned_value"] > ledger["start_value"]


def test_halving_finds_the_best_where_parts_resemble_the_whole(spark):
    from tapewright.operators import simulate

    rows = []
    for s, stretch in (("a", 9), ("b", 14)):
        for i in range(1, 1201):
            k = i % stretch
            close = 100 + (k if k < stretch / 2 else stretch - k) * 2.0
            rows.append((s, i, close, close + 0.5, close - 0.5, close, int(k == 0) - int(k == stretch // 2), 1.0))
    df = spark.createDataFrame(rows, "symbol string, bar_no long, open double, high double, low double, close double, signal int, atr double")
    pairs = spark.createDataFrame([(0.5 + 0.25 * i, 0.5 + 0.25 * j) for i in range(20) for j in range(20)], "stop_mult double, reward double")
    got = {r["symbol"]: r for r in simulate.halving(df, pairs, [0.1, 0.3, 1.0]).collect()}
    whole = simulate.sweep(df, pairs).collect()
    for s in ("a", "b"):
        best = max((r for r in whole if r["symbol"] == s), key=lambda r: (r["total"], -r["stop_mult"], -r["reward"]))
        assert got[s]["total"] == pytest.approx(best["total"])
    found = QUERIES["k17_halving"](spark, SMALL).collect()
    assert found and all(0.5 <= r["stop_mult"] <= 3 and 1 <= r["reward"] <= 4.1 for r in found)


def test_factors_follow_their_returns(spark):
    rng = np.random.default_rng(2)
    z = np.zeros(3)
    kernel = models.factors(q=0.01, r=0.01)
    rows, true = [], []
    for _ in range(600):
        z = 0.95 * z + rng.normal(0, 0.1, 3)
        rows.append(models.MIX @ z + rng.normal(0, 0.1, 5))
        true.append(z)
    y, true = np.array(rows), np.array(true)
    y[10, :] = np.nan
    y[20, 1] = np.nan
    out = kernel({c: y[:, i] for i, c in enumerate(models.MIX_ORDER)})
    got = np.stack([out[c] for c in ("trend", "volatility", "momentum")], 1)
    x, p = np.zeros(3), np.eye(3)
    for i, row in enumerate(y):  # one return at a time, which is the same filter
        x, p = 0.95 * x, 0.9025 * p + 0.01 * np.eye(3)
        for h, v in zip(models.MIX, row, strict=True):
            if not np.isnan(v):
                g = p @ h / (h @ p @ h + 0.01)
                x, p = x + g * (v - h @ x), p - np.outer(g, h) @ p
        assert np.allclose(got[i], x, atol=1e-8)
    assert np.corrcoef(got[50:, 0], true[50:, 0])[0, 1] > 0.7
    assert {r["regime"] for r in QUERIES["k07_factor_filter"](spark, SMALL).collect()} <= {"UP", "DOWN", "VOLATILE", "MOMENTUM"}


def test_cells_lose_no_neighbour_and_make_few_pairs(spark):
    from tapewright.operators import cells

    rng = np.random.default_rng(8)
    middles = rng.normal(0, 10, (20, 6))
    x = np.concatenate([m + rng.normal(0, 1, (60, 6)) for m in middles] + [np.repeat(middles[:1], 30, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(5)
    asked = df.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")).unionByName(spark.createDataFrame([(-1, [50.0] * 6)], "query_id long, qv array<double>"))
    index = cells.build(df, "vec_id", "v", 16)
    assert index.rows.count() == len(x)
    for k in (1, 7):
        got = {}
        for r in cells.nearest(index, asked, "v", k, probes=1).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["vec_id"])
        for r in asked.collect():
            d = ((x - np.array(r["qv"])) ** 2).sum(1).round(9)
            want = sorted((float(d[i]), i) for i in range(len(x)) if i != r["query_id"])[:k]
            assert [(round(a, 6), b) for a, b in (got[r["query_id"]][n + 1] for n in range(k))] == [(round(a, 6), b) for a, b in want]
    assert cells.share_of_pairs(index, asked, 1) < 0.15
    assert cells.nearest(cells.build(df.where("false"), "vec_id", "v"), asked.where("false"), "v", 3).isEmpty()

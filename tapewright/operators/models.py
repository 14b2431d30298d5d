"""Estimators: neighbours, clusters, filters and small dense problems on what Spark has aggregated."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions.scans import Arrays
from tapewright.operators import blocks
from tapewright.sources.staging import staged

def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def kmeans(df: DataFrame, features: list[str], k: int, rounds: int = 10, order: str = "id") -> tuple[list[list[float]], DataFrame]:
    """Lloyd's algorithm from centres strided over ``order``; a round is one aggregation to k rows.

    Empty clusters keep their centre. Gives the centres and ``df`` with ``cluster`` (the lowest number at ties).
    """
    df = staged(df, "features")
    n = df.count()
    at = sorted({int(i * n / k) for i in range(k)})
    centres = [[float(r[f]) for f in features] for r in blocks.rows_at(df, order, at)]

    def nearest(centres: list[list[float]]) -> Column:
        options = [F.struct(sum(((F.col(f) - c) ** 2 for f, c in zip(features, centre, strict=True)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, centre in enumerate(centres)]
        return F.array_min(F.array(*options))["i"]

    for _ in range(rounds):
        found = {r["c"]: [r[f] for f in features] for r in df.groupBy(nearest(centres).alias("c")).agg(*(F.avg(f).alias(f) for f in features)).collect()}
        new = [found.get(i, c) for i, c in enumerate(centres)]
        if new == centres:
            break
        centres = new
    return centres, df.withColumn("cluster", nearest(centres))


def quantile_lines(df: DataFrame, x: str, y: str, by: list[str], taus: list[float], rounds: int = 25, least: float = 1e-4) -> DataFrame:
    """(by, tau, intercept, slope) of the line below which a share ``tau`` of the rows of each group lies.

    Reweighted least squares: a round is one aggregation of five sums by group and quantile, whose rows (groups times
    quantiles) weight the next round. Residuals under ``least`` count as that much.
    """
    keys = [*by, "tau"]
    rows = staged(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "points")
    each = rows.withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    lines = None
    for _ in range(rounds):
        if lines is None:
            weighed = each.withColumn("w", F.lit(1.0))
        else:
            e = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
            weighed = each.join(F.broadcast(lines), keys).withColumn("w", F.when(e > 0, F.col("tau")).otherwise(1 - F.col("tau")) / F.greatest(F.abs(e), F.lit(least)))
        w, total = F.col("w"), lambda v: F.sum(F.col("w") * v)
        sums = weighed.groupBy(*keys).agg(F.sum(w).alias("n"), total(F.col("x")).alias("sx"), total(F.col("y")).alias("sy"), total(F.col("x") ** 2).alias("sxx"), total(F.col("x") * F.col("y")).alias("sxy"))
        spread = F.col("n") * F.col("sxx") - F.col("sx") ** 2
        slope = F.when(spread > 1e-12 * F.col("n") * F.col("sxx"), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).otherwise(0.0)
        found = sums.withColumn("slope", slope).select(*keys, ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"), "slope").collect()
        schema = [*(rows.schema[k] for k in by), *sums.select("tau", F.lit(0.0).alias("intercept"), F.lit(0.0).alias("slope")).schema]
        lines = df.sparkSession.createDataFrame(found, T.StructType(schema))
    return lines


def kalman(q: float = 0.01, r: float = 1.0):
    """A level and a slope behind noisy values; ``level``, ``slope`` and ``gain`` of the level at each step."""

    def kernel(a: Arrays) -> Arrays:
        y = a["close"]
        x, p = np.array([y[0] if len(y) else 0.0, 0.0]), np.eye(2)
        f, h, noise = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([1.0, 0.0]), q * np.eye(2)
        out = {k: np.full(len(y), np.nan) for k in ("level", "slope", "gain")}
        for i, v in enumerate(y):
            x, p = f @ x, f @ p @ f.T + noise
            if not np.isnan(v):
                g = p @ h / (h @ p @ h + r)
                x, p = x + g * (v - h @ x), p - np.outer(g, h) @ p
                out["gain"][i] = g[0]
            out["level"][i], out["slope"][i] = x
        return out

    return kernel


#: Fixed values of the survey's K7: how each observed return mixes the three factors, in the order of symbols.
MIX_ORDER = ["click", "error", "purchase", "signup", "view"]
MIX = np.array([[0.6, 0.3, 0.1], [0.5, 0.4, 0.1], [0.5, 0.3, 0.2], [-0.4, 0.4, 0.2], [0.4, 0.3, 0.3]])


def factors(stay: float = 0.95, q: float = 0.01, r: float = 0.10):
    """Three factors that fade by ``stay`` a step behind five noisy returns; missing returns are left out of a step."""

    def kernel(a: Arrays) -> Arrays:
        y = np.stack([a[c] for c in MIX_ORDER], 1)
        x, p = np.zeros(3), np.eye(3)
        out = np.full((len(y), 4), np.nan)
        for i, row in enumerate(y):
            x, p = stay * x, stay**2 * p + q * np.eye(3)
            known = ~np.isnan(row)
            if known.any():
                h = MIX[known]
                gain = np.linalg.solve(h @ p @ h.T + r * np.eye(len(h)), h @ p).T
                x, p = x + gain @ (row[known] - h @ x), (np.eye(3) - gain @ h) @ p
            out[i] = *x, np.trace(p)
        return dict(zip(("trend", "volatility", "momentum", "doubt"), out.T, strict=True))

    return kernel


def riccati(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray, rounds: int = 500, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Cost matrix and gain of the regulator, by iteration."""
    p = q
    for _ in range(rounds):
        k = np.linalg.solve(r + b.T @ p @ b, b.T @ p @ a)
        new = q + a.T @ p @ (a - b @ k)
        if np.abs(new - p).max() < tolerance:
            break
        p = new
    return p, k


def value_iteration(counts: dict[tuple[str, str, str], tuple[float, float]], discount: float = 0.9, rounds: int = 200) -> tuple[dict[str, float], dict[str, str]]:
    """Values and best actions from (state, action, next state) -> (transitions, total reward)."""
    by: dict[str, dict[str, list]] = {}
    for (s, a, t), (n, reward) in sorted(counts.items()):
        by.setdefault(s, {}).setdefault(a, []).append((t, n, reward))
    value = dict.fromkeys({x for s, _, t in counts for x in (s, t)}, 0.0)

    def worth(s: str, a: str) -> float:
        total = sum(n for _, n, _ in by[s][a])
        return sum(reward + discount * n * value[t] for t, n, reward in by[s][a]) / total

    for _ in range(rounds):
        value |= {s: max(worth(s, a) for a in by[s]) for s in by}
    return value, {s: max(sorted(by[s]), key=lambda a: worth(s, a)) for s in by}


def clean_correlation(corr: np.ndarray, q: float) -> np.ndarray:
    """Eigenvalues under the random bound (1 + sqrt(q))^2 become their mean; ones on the diagonal again."""
    w, v = np.linalg.eigh(corr)
    noise = w < (1 + np.sqrt(q)) ** 2
    if noise.any():
        w = np.where(noise, w[noise].mean(), w)
    out = v @ np.diag(w) @ v.T
    d = np.sqrt(np.diag(out))
    return out / np.outer(d, d)

"""Independent components and distances from the mean of vectors; every step is one aggregation of a few sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.sources.staging import staged


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance (over n) of vectors: each partition sums its own, the sums meet by their place."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            x = np.stack(frame[vector].to_list()) if len(frame) else None
            if x is not None:
                one = np.hstack([np.ones((len(x), 1)), x])
                total = one.T @ one if total is None else total + one.T @ one
        if total is not None:
            yield pd.DataFrame({"at": np.arange(total.size), "s": total.ravel()})

    found = df.where(F.col(vector).isNotNull()).select(vector).mapInPandas(sums, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()  # the square of the vectors' length
    if not found:
        return 0, np.zeros(0), np.zeros((0, 0))
    size = round(len(found) ** 0.5)
    m = np.zeros(len(found))
    m[[r["at"] for r in found]] = [r["s"] for r in found]
    m = m.reshape(size, size)
    n = round(m[0, 0])
    mean = m[0, 1:] / n
    return n, mean, m[1:, 1:] / n - np.outer(mean, mean)


def projected(df: DataFrame, vector: str, mean: np.ndarray, matrix: np.ndarray, names: list[str]) -> DataFrame:
    """``df`` with ``names``, the rows of ``matrix`` times (vector - mean)."""
    centred = F.zip_with(vector, F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b)
    dot = lambda w: F.aggregate(F.zip_with("_c", F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("_c", centred).select("*", *(dot(w).alias(n) for n, w in zip(names, matrix, strict=True))).drop("_c")


def independent(df: DataFrame, vector: str, k: int, rounds: int = 40, tolerance: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and a matrix (components by vector length) whose rows give independent components of variance 1.

    Vectors are whitened along their ``k`` principal directions. A component's direction w goes to E[z g(w z)] - E[g'(w z)] w
    with g the hyperbolic tangent, less its part along the directions before it (deflation), until it stays: one
    aggregation of k + 1 sums a round. Signs are such that a direction's largest entry is positive.
    """
    n, mean, cov = moments(df, vector)
    if n < 10:
        raise ValueError(f"{n} vectors are too few for components")
    values, directions = np.linalg.eigh(cov)
    most = np.argsort(-values)[: min(k, int((values > 1e-12 * values.max()).sum()))]
    white = directions[:, most].T / np.sqrt(values[most])[:, None]
    names = [f"z{i}" for i in range(len(most))]
    rows = staged(projected(df.where(F.col(vector).isNotNull()).select(vector), vector, mean, white, names).select(*names), "whitened")
    rng = np.random.default_rng(seed)
    found: list[np.ndarray] = []

    def away(w: np.ndarray) -> np.ndarray:
        for other in found:
            w = w - (w @ other) * other
        return w / np.linalg.norm(w)

    for _ in names:
        w = away(rng.standard_normal(len(names)))
        for _ in range(rounds if len(found) + 1 < len(names) else 0):  # the last direction is all that is left
            g = F.tanh(sum((F.col(c) * float(x) for c, x in zip(names, w, strict=True)), F.lit(0.0)))
            s = rows.agg(*(F.avg(F.col(c) * g).alias(c) for c in names), F.avg(1 - g * g).alias("slope")).first()
            new = away(np.array([s[c] for c in names]) - s["slope"] * w)
            done = abs(abs(new @ w) - 1) < tolerance
            w = new
            if done:
                break
        found.append(w if w[np.argmax(np.abs(w))] > 0 else -w)
    return mean, np.array(found) @ white


def distances(df: DataFrame, vector: str, out: str, least: float = 1e-10) -> DataFrame:
    """``df`` with the Mahalanobis norm of each vector: its length once all directions have variance 1.

    Directions of less than ``least`` of the largest variance are left out.
    """
    n, mean, cov = moments(df, vector)
    if not n:
        return df.withColumn(out, F.lit(None).cast("double"))
    values, directions = np.linalg.eigh(cov)
    kept = values > least * values.max()
    white = directions[:, kept].T / np.sqrt(values[kept])[:, None]

    @F.pandas_udf("double")
    def norm(v: pd.Series) -> pd.Series:
        known = v.notna()
        made = pd.Series(np.nan, index=v.index)
        if known.any():
            made[known] = np.sqrt((((np.stack(v[known].to_list()) - mean) @ white.T) ** 2).sum(1))
        return made

    return df.withColumn(out, F.when(F.col(vector).isNotNull(), norm(F.col(vector))))

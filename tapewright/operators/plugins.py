"""Where users' own code goes in: signals, models, window aggregates, stages and table functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import scans

SIGNALS: dict[str, Callable[[scans.Arrays], np.ndarray]] = {}


def signal(name: str) -> Callable:
    """Register a function from a symbol's arrays to a signal for each bar."""

    def keep(f: Callable[[scans.Arrays], np.ndarray]) -> Callable[[scans.Arrays], np.ndarray]:
        SIGNALS[name] = f
        return f

    return keep


def with_signal(df: DataFrame, name: str, inputs: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    f = SIGNALS[name]
    return scans.scan(df, lambda a: {"signal": np.asarray(f(a), dtype=float)}, ["signal"], inputs)


def predict(model: Callable[[pd.DataFrame], pd.Series], columns: Sequence[str]) -> Column:
    """A model's prediction from whole batches of rows; it gets a frame of the columns."""

    @F.pandas_udf("double")
    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(model(pd.concat(parts, axis=1, keys=columns)), dtype=float))

    return run(*columns)


def rolling_apply(df: DataFrame, value: str, n: int, f: Callable[[np.ndarray], float], out: str) -> DataFrame:
    """A user's aggregate over each full frame of ``n`` bars of a symbol."""

    def kernel(a: scans.Arrays) -> scans.Arrays:
        x = a[value]
        made = np.full(len(x), np.nan)
        if len(x) >= n:
            for i, frame in enumerate(np.lib.stride_tricks.sliding_window_view(x, n)):
                if not np.isnan(frame).any():
                    made[i + n - 1] = f(frame)
        return {out: made}

    return scans.scan(df, kernel, [out], [value])


def lifecycle(df: DataFrame, stages: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Stages in order, as one lazy plan."""
    for stage in stages:
        df = df.transform(stage)
    return df


def experiment(df: DataFrame, base: dict[str, float], changes: dict[str, float], run: Callable[[DataFrame, dict[str, float]], DataFrame], keys: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """``run`` under a base configuration and a changed one, side by side; changes outside ``allowed`` are an error."""
    if outside := sorted(set(changes) - set(allowed)):
        raise ValueError(f"not open to change: {outside}")
    a, b = run(df, base), run(df, base | changes)
    measures = [c for c in a.columns if c not in keys]
    renamed = b.select(*keys, *(F.col(c).alias(f"{c}_new") for c in measures))
    return a.join(renamed, list(keys), "full")

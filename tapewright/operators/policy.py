"""A Gaussian policy over actions, improved from a ledger of actions taken and rewards earned."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.sources.staging import staged

ACTIONS = ["quantity", "notional", "days"]


@dataclass(frozen=True)
class Step:
    mean: tuple[float, ...]
    sigma: float
    value: float  # mean reward under the policy, from rewards weighted by how likely it takes their actions


def learn(ledger: DataFrame, actions: Sequence[str], reward: str, steps: int = 15, start: float = 0.5, sigma: float = 0.2, rate: float = 0.05, momentum: float = 0.8) -> list[Step]:
    """The policies along a gradient ascent of the mean reward; actions are from 0 to 1, and the policy does not depend on a state.

    A step is one aggregation: rows weigh what the policy's density says of their actions, the baseline is the weighted mean reward, and the
    gradient is the weighted mean of (action - mean) (reward - baseline) / sigma squared, each entry from -0.5 to 0.5.
    """
    rows = staged(ledger.select(*(F.col(a).cast("double").alias(f"a{i}") for i, a in enumerate(actions)), F.col(reward).cast("double").alias("r")).dropna(), "policy-rows")
    names = [f"a{i}" for i in range(len(actions))]
    mean, push, out = [start] * len(names), [0.0] * len(names), []
    for t in range(steps + 1):
        far = sum((F.pow(F.col(a) - m, 2) for a, m in zip(names, mean, strict=True)), F.lit(0.0))
        w = F.exp(-far / (2 * sigma * sigma))
        s = rows.agg(F.sum(w).alias("w"), F.sum(w * F.col("r")).alias("r"), *(F.sum(w * F.col(a)).alias(a) for a in names), *(F.sum(w * F.col(a) * F.col("r")).alias(f"{a}r") for a in names)).first()
        total = s["w"] or 0.0
        if total < 1e-12:
            out.append(Step(tuple(mean), sigma, 0.0))
            break
        value = s["r"] / total
        out.append(Step(tuple(mean), sigma, value))
        gradient = [(s[f"{a}r"] - m * s["r"] - value * (s[a] - m * total)) / total / sigma**2 for a, m in zip(names, mean, strict=True)]
        push = [momentum * p + (1 - momentum) * min(0.5, max(-0.5, g)) for p, g in zip(push, gradient, strict=True)]
        mean = [min(1.0, max(0.0, m + rate / math.sqrt(1 + t / 10) * p * 10)) for m, p in zip(mean, push, strict=True)]
        sigma = max(0.05, sigma * 0.99)
    return out

"""Gradient boosting of quantiles: trees grown from histograms, a level by one aggregation."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.sources.staging import staged

#: Combinations of nodes of several trees that are counted together.
MOST_NODES = 512


@dataclass
class Tree:
    """Splits by node (children of i are 2i and 2i + 1, the root is 1) and values of leaves."""

    splits: dict[int, tuple[str, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def node(self, at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(at)
        name, cut = self.splits[at]
        return F.when(F.col(name) <= cut, self.node(2 * at)).otherwise(self.node(2 * at + 1))

    def value(self, at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(self.values.get(at, 0.0))
        name, cut = self.splits[at]
        return F.when(F.col(name) <= cut, self.value(2 * at)).otherwise(self.value(2 * at + 1))


@dataclass
class Quantiles:
    """A start and trees for each quantile, over features cut into bins."""

    cuts: dict[str, list[float]]
    start: dict[float, float]
    trees: dict[float, list[Tree]]
    rate: float

    def binned(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_bin_{c}": sum(((F.col(c) > x).cast("int") for x in cuts), F.lit(0)) for c, cuts in self.cuts.items()})

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with a column ``q_<percent>`` for each quantile; nulls of features fall into the lowest bin."""
        made = self.binned(df.na.fill(float("-inf"), list(self.cuts)) if self.cuts else df)
        added = {name(tau): sum((self.rate * t.value() for t in self.trees[tau]), F.lit(self.start[tau])) for tau in self.start}
        return made.withColumns(added).drop(*(f"_bin_{c}" for c in self.cuts))


def name(tau: float) -> str:
    return f"q_{round(tau * 100)}"


def pinball(y: Column, q: Column, tau: float) -> Column:
    return F.when(y >= q, tau * (y - q)).otherwise((1 - tau) * (q - y))


def fit_quantiles(df: DataFrame, features: Sequence[str], y: str, taus: Sequence[float], rounds: int = 10, depth: int = 2, rate: float = 0.3, bins: int = 16, least: int = 50) -> Quantiles:
    """Boosted trees under the pinball loss, for several quantiles at once.

    A row's gradient is tau above its prediction and tau - 1 below. For every level of a round's trees one aggregation gives the number and
    sum of gradients by quantile, node, feature and bin, from which each node takes the split that lowers squared gradients
    most, with ``least`` rows on either side; a leaf's value is the quantile of what is left of its rows (a sketch of bounded size).
    """
    rows = df.where(F.col(y).isNotNull()).select(*(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(c) for c in features), F.col(y).cast("double").alias("_y"))
    rows = staged(rows, "boosting-rows")
    edges = rows.agg(*(F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000).alias(c) for c in features), F.percentile_approx("_y", list(taus), 10_000).alias("_start")).first()
    cuts = {c: sorted(set(edges[c] or [])) for c in features}
    model = Quantiles(cuts, dict(zip(taus, edges["_start"] or [0.0] * len(taus), strict=True)), {t: [] for t in taus}, rate)
    now = staged(model.binned(rows).select(*(f"_bin_{c}" for c in features), "_y", *(F.lit(model.start[t]).alias(name(t)) for t in taus)), "boosting-bins")
    for _ in range(rounds):
        trees = {t: Tree() for t in taus}
        for level in range(depth):
            grow(now, trees, features, level, least)
        nodes = F.explode(F.array(*(F.struct(F.lit(t).alias("tau"), trees[t].node().alias("node"), (F.col("_y") - F.col(name(t))).alias("e")) for t in taus))).alias("x")
        left = now.select(nodes).select("x.*").groupBy("tau", "node").agg(F.percentile_approx("e", list(taus), 10_000).alias("q")).collect()  # a row a leaf
        for r in left:
            trees[r["tau"]].values[r["node"]] = r["q"][list(taus).index(r["tau"])]
        for t in taus:
            model.trees[t].append(trees[t])
        now = staged(now.withColumns({name(t): F.col(name(t)) + rate * trees[t].value() for t in taus}), "boosting-bins")
    return model


def grow(rows: DataFrame, trees: dict[float, Tree], features: Sequence[str], level: int, least: int) -> None:
    """Split the nodes of a level.

    A row counts once a feature for several quantiles together: its key is one number, made of the feature, the bin and the row's node
    in each tree, and gradients are sums of numbers of rows above their prediction. Quantiles are taken together as long as keys stay few.
    """
    base = 2 << level
    together = max(1, int(math.log(MOST_NODES, base)))
    by: dict[tuple[float, int], dict[str, dict[int, list]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(lambda: [0, 0])))
    for first in range(0, len(trees), together):
        taus = list(trees)[first : first + together]
        nodes = sum((trees[t].node() * base**i for i, t in enumerate(taus)), F.lit(0))
        at = rows.select(nodes.cast("long").alias("nodes"), *(f"_bin_{c}" for c in features), *((F.col("_y") > F.col(name(t))).cast("long").alias(name(t)) for t in taus))
        size = base ** len(taus)
        keys = F.array(*(F.col("nodes") + size * (F.lit(i) + len(features) * F.col(f"_bin_{c}").cast("long")) for i, c in enumerate(features)))
        found = at.select(F.explode(keys).alias("key"), *(name(t) for t in taus)).groupBy("key").agg(F.count("*").alias("n"), *(F.sum(name(t)).alias(name(t)) for t in taus)).collect()  # nodes times features times bins
        for r in found:
            rest, code = divmod(r["key"], size)
            bin_, i = divmod(rest, len(features))
            for j, t in enumerate(taus):
                if (node := code // base**j % base) >= 1 << level:
                    sums = by[t, node][features[i]][bin_]
                    sums[0] += r["n"]
                    sums[1] += r[name(t)]
    for (tau, node), histograms in sorted(by.items()):
        histograms = {f: [(at, n, tau * n - (n - above)) for at, (n, above) in cells.items()] for f, cells in histograms.items()}
        best = None
        for feature, cells in sorted(histograms.items()):
            n, g = sum(c[1] for c in cells), sum(c[2] for c in cells)
            below = total = 0.0
            for at, count, grad_sum in sorted(cells)[:-1]:
                below, total = below + count, total + grad_sum
                if min(below, n - below) >= least:
                    gain = total**2 / below + (g - total) ** 2 / (n - below) - g**2 / n
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, f"_bin_{feature}", at)
        if best:
            trees[tau].splits[node] = best[1:]

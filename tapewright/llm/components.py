"""Connected components of an edge table.

Every round first contracts the edges of each partition on its own (a forest of its nodes comes out, never more edges
than went in), then joins the partitions' forests by a large-star and a small-star step, each an aggregation and a
join on nodes. Partitions hold some ``TASK_ROWS`` edges; edges that fit into one are done in one contraction, and
long chains shorten by half at least in each round otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import TASK_ROWS, join_counted, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = _both(edges)
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", 2 * n)
    return join_counted(both.where("v > u"), least, ["u"], "inner", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least", n)
    links = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return join_counted(down, least, ["u"], "inner", n).select(F.explode(links).alias("e")).select("e.u", "e.v")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def find(up: dict[int, int], x: int) -> int:
    """The root of ``x`` in a forest of links to smaller nodes, with the way there cut short."""
    root = x
    while (above := up.get(root, root)) != root:
        root = above
    while (above := up.get(x, x)) != root:
        up[x] = root
        x = above
    return root


def unite(up: dict[int, int], x: int, y: int) -> bool:
    """Make the trees of ``x`` and ``y`` one, under the lesser root; false if they are one already."""
    a, b = find(up, x), find(up, y)
    if a != b:
        up[max(a, b)] = min(a, b)
    return a != b


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            unite(up, u, v)
    nodes = list(up)
    yield pd.DataFrame({"u": nodes, "v": [find(up, x) for x in nodes]}, dtype="int64")


def components(links: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long; read twice); the root is the least node of its component.

    Self links are ignored, links may repeat; an empty table gives an empty result.
    """
    edges = links.where("u is not null and v is not null and u <> v").select("u", "v")
    before = _signature(edges)
    while n := before[0]:  # no step makes more different links than it was given
        parts = -(-n // task_rows)
        edges = written(edges.coalesce(parts).mapInPandas(_contracted, "u long, v long"), "forests", None if parts > 1 else n)
        if parts == 1:
            break
        edges = written(_large_star(edges, n).where("u <> v").distinct(), "edges", n)
        edges = written(_small_star(edges, n).where("u <> v").distinct(), "edges", n)
        after = _signature(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

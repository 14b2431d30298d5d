"""Shared plumbing: the cluster's shared folder, written intermediate tables, fresh column names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tapewright.sources.staging import scratch as fresh_path


#: Rows of a few numbers that one task writes, where the number of rows is known.
TASK_ROWS = 100_000
#: Paths of the tables written within each open ``tidy``, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables written within, but for those written with ``keep``, on the way out."""
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, rows: int | None = None, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    A lost executor then only repeats tasks after this point, and what several branches read is made once. With
    ``rows``, a known bound on the rows, no more tasks write than they need. With ``keep`` the table outlives the
    innermost ``tidy``, as what a returned frame reads must.
    """
    path = fresh_path(df.sparkSession, name)
    scopes = _scopes.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    if rows is not None:
        df = df.coalesce(rows // TASK_ROWS + 1)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that are not in ``taken`` (Spark tells names apart without their case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *results: str) -> list[str]:
    """The columns of ``df`` but for those with the names of results, which replace them."""
    gone = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in gone]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


#: Rows of a few numbers up to which a counted side is sent to every executor.
SMALL_ROWS = 200_000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join with the right side broadcast if its ``rows``, counted beforehand, are few, and by shuffle otherwise."""
    if rows <= SMALL_ROWS:
        from pyspark.sql import functions as F

        right = F.broadcast(right)
    return left.join(right, on, how)

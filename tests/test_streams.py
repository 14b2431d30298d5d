"""Streams give the same rows however their input is written, named, dated and sliced."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from tapewright.plans import stream_queries
from tapewright.streaming import ticks

SMALL = "/root/testdata/sf0.001"
NAMES = ["l03_tumbling_bars", "l04_session_vwap", "l05_opening_range", "l06_order_timeout", "l07_stale_decisions", "l08_silence", "l10_anomalies", "l11_once", "j07_paper_trades"]


@pytest.fixture
def scattered(spark, monkeypatch):
    """Every task writes a file of each slice, and the files of later slices are the older ones."""
    made = stream_queries.arriving

    def arriving(*args, **kwargs):
        out = made(*args, **kwargs)
        files = sorted(Path(out.staged.removeprefix("file://")).rglob("*.parquet"))
        for i, f in enumerate(reversed(files)):
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
        return out

    monkeypatch.setattr(stream_queries, "arriving", arriving)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("slices", [1, 7])
@pytest.mark.parametrize("name", NAMES)
def test_order_of_slices_and_files(spark, scattered, monkeypatch, name, slices):
    monkeypatch.setattr(stream_queries, "SLICES", slices)
    assert not differences(stream_queries.QUERIES[name](spark, SMALL), duck(SMALL), stream_queries.SQL[name])


def test_rows_wait_for_the_watermark(spark, monkeypatch):
    """Rows that come up to ten minutes late, in three slices that overlap, are taken in the order of their time."""
    monkeypatch.setattr(stream_queries, "SLICES", 3)
    part = {i: i // 10 for i in range(30)} | {12: 0, 13: 0, 14: 0, 8: 1, 9: 1, 23: 1, 17: 2, 3: 2}  # 3 comes too late
    rows = [(s, i, part[i]) for s in ("a", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, no long, part int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("no") * 60)).repartition(5)
    step = lambda key, frame, before: ((before[0] + len(frame),), [(key, int(n), before[0] + k + 1) for k, n in enumerate(frame["no"])])
    came = stream_queries.arriving(spark, df, "overlapping", "part", [0, 1])
    out = ticks.in_time_order(came.stream, "symbol", ["ts"], (0,), step, "symbol string, no long, seen long", "n long", "10 minutes")
    got = {(r["symbol"], r["no"]): r["seen"] for r in stream_queries.finished(spark, out, "overlapping", came).collect()}
    due = [i for i in range(20) if i != 3]  # the mark ends ten minutes before the last row
    assert got == {(s, i): k + 1 for s in ("a", "b") for k, i in enumerate(due)}


def test_outcome_before_its_decision(spark, monkeypatch):
    """Whichever comes first labels; a decision runs out only when more than 48 hours have passed."""
    monkeypatch.setattr(stream_queries, "SLICES", 2)
    monkeypatch.setattr(stream_queries, "moment", lambda c, kind: F.col("part"))
    hour = lambda df: df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600))
    decisions = hour(spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 50, 1), (5, 3, 0)], "decision long, h int, part int"))
    outcomes = hour(spark.createDataFrame([(2, 30, 1), (4, 2, 0), (5, 1, 0)], "decision long, h int, part int"))
    came = [stream_queries.arriving(spark, x, n, "part", [0]) for x, n in ((decisions, "made"), (outcomes, "came"))]
    before = spark.conf.get(stream_queries.STORE, None)
    spark.conf.set(stream_queries.STORE, ticks.ROCKS)
    got = stream_queries.finished(spark, ticks.stale(*(a.stream for a in came)), "stale", *came).collect()
    spark.conf.unset(stream_queries.STORE) if before is None else spark.conf.set(stream_queries.STORE, before)
    assert sorted(map(tuple, got)) == [(1, "expired"), (2, "labelled"), (4, "labelled"), (5, "labelled")]  # 3 is 48 hours old at the end


def test_a_bucket_of_decisions_is_taken_at_once():
    """One call takes all decisions of a key; one timer, at the earliest end, expires what is over then and moves on."""
    import pandas as pd

    class Handle:
        def __init__(self):
            self.state, self.timers = None, []

        getValueState = lambda self, name, schema: self
        exists = lambda self: self.state is not None
        get = lambda self: self.state
        registerTimer = lambda self, at: self.timers.append(at)
        deleteTimer = lambda self, at: self.timers.remove(at)
        getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: self.timers.pop() if self.timers else 0

        def update(self, value):
            self.state = value

        def clear(self):
            self.state = None

    handle, job = Handle(), ticks.Expiry(1)
    job.init(handle)
    rows = lambda *r: iter([pd.DataFrame(r, columns=["decision", "ms", "placed"])])
    told = lambda frames: [tuple(r) for f in frames for r in f.itertuples(index=False)]
    assert told(job.handleInputRows((0,), rows((1, 10, True), (2, 20, True), (3, 5, False), (4, 30, True), (4, 40, False)), handle)) == [(4, "labelled")]
    assert handle.timers == [10 + 3_600_001]
    assert told(job.handleInputRows((0,), rows((3, 50, True), (5, 60, True)), handle)) == [(3, "labelled")]
    assert told(job.handleExpiredTimer((0,), handle, handle)) == [(1, "expired")] and handle.timers == [20 + 3_600_001]
    assert told(job.handleInputRows((0,), rows((2, 70, False)), handle)) == [(2, "labelled")] and handle.timers == [60 + 3_600_001]

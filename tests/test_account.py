"""Draws without replacement and the shared account, against plain loops."""

from __future__ import annotations

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tapewright.operators import account, drawing


@pytest.mark.parametrize("width", [6.0, 0.3])  # of a narrow band most draws have to be made again
def test_draws_take_exactly_the_least_hashes(spark, width):
    rng = random.Random(2)
    rows = [(g, i, float(rng.randrange(100))) for g, n in (("a", 60), ("b", 7), ("c", 3), ("d", 5)) for i in range(n)]
    want = {"a": 9, "b": 7, "c": 10, "d": 0}
    got = drawing.sums_of_draws(spark.createDataFrame(rows, "g string, i long, x double"), spark.createDataFrame(list(want.items()), "g string, k long"), "x", "i", "g", 25, width=width).collect()
    found = {(r["g"], r["sim"]): (r["n"], r["total"]) for r in got}
    assert len(found) == len(got) == 75
    for (g, sim), (n, total) in found.items():
        own = sorted((int(hashlib.md5(f"11/{g}/{sim}/{i}".encode()).hexdigest()[:12], 16) % drawing.RANGE, i, x) for h, i, x in rows if h == g)
        assert n == min(want[g], len(own)) and total == sum(x for *_, x in own[:n])
    none = drawing.sums_of_draws(spark.createDataFrame([], "g string, i long, x double"), spark.createDataFrame([], "g string, k long"), "x", "i", "g", 3)
    assert none.isEmpty()


@pytest.mark.parametrize("parts", ["1", "7"])
def test_shared_equity_is_that_of_a_loop_over_dates(spark, parts):
    rng = random.Random(6)
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    trades = []
    for s in "abcd":
        d = rng.randrange(5)
        while d < 200:
            out = d + rng.randint(1, 15)
            trades.append((s, day(d), day(out), rng.uniform(-0.3, 0.4)))
            d = out + rng.randint(0, 4) + 1
    events = sorted({t for _, a, b, _ in trades for t in (a, b)})
    equity, held, want, top = 1000.0, {}, [], 1000.0
    for t in events:
        for s, _, b, ret in sorted(trades):
            if b == t:
                equity += held.pop(s) * ret
        for s, a, _, _ in trades:
            if a == t:
                held[s] = 0.25 * equity
        top = max(top, equity)
        want.append((t, round(equity, 6), len(held), round(equity / top - 1, 9)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = spark.createDataFrame(trades, "symbol string, opened timestamp_ntz, closed timestamp_ntz, ret double").repartition(5)
    got = account.drawdown(account.shared_equity(rows, 1000.0), 1000.0).select("step", F.round("equity", 6), "n_open", F.round("drawdown", 9)).orderBy("step").collect()
    none = account.shared_equity(rows.where("false")).isEmpty()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [tuple(r) for r in got] == want and none

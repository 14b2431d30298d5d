"""Neighbours, clusters, regressions and classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions import scans
from tapewright.functions.frames import prev
from tapewright.operators import metrics as m
from tapewright.operators import boosting, cells, components, models, nearest, order_stats, policy, scalars
from tapewright.plans.gate_queries import features
from tapewright.plans.registry import Registry
from tapewright.plans.sql import BARS, TRADES, lag
from tapewright.sources.market import bars, table, trades
from tapewright.sources.staging import staged

query = Registry()
QUERIES, SQL = query.queries, query.sql

VEC = "list_transform(embedding, lambda x: x::DOUBLE)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


KNN = f"e AS (SELECT vec_id, label, {VEC} AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, list_cosine_similarity(q.v, e.v) AS sim, list_distance(q.v, e.v) ** 2 AS d FROM e JOIN e q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)"


@query(
    "k01_cosine_library",
    f"WITH {KNN}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(-sim, 9), vec_id) AS k FROM p) SELECT query_id, round(sum(sim * exp(-0.4 * (k - 1))) / sum(exp(-0.4 * (k - 1))), 5) AS score, count(*) FILTER (sim > 0.6) >= 3 AS converged FROM k WHERE k <= 5 GROUP BY 1",
)
def cosine_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of each query (ids divisible by 50), weighted by rank."""
    e = vectors(spark, sf_dir)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    top = nearest.neighbours(e, q, 5, "cosine")
    w = F.exp(-0.4 * (F.col("rank") - 1))
    return top.groupBy("query_id").agg(F.round(F.sum(-F.col("distance") * w) / F.sum(w), 5).alias("score"), (F.count_if(-F.col("distance") > 0.6) >= 3).alias("converged"))


@query("k03_neighbour_veto", f"WITH {KNN}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS k FROM p) SELECT query_id, count(*) FILTER (label = 1) AS ones, count(*) FILTER (label = 1) >= 5 AS block FROM k WHERE k <= 10 GROUP BY 1")
def neighbour_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    top = nearest.neighbours(e, q, 10)
    return top.groupBy("query_id").agg(F.count_if(F.col("label") == 1).alias("ones"), (F.count_if(F.col("label") == 1) >= 5).alias("block"))


@query("k03_indexed_veto", SQL["k03_neighbour_veto"])
def indexed_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same neighbours as ``k03_neighbour_veto``, from cells around centres."""
    e = vectors(spark, sf_dir)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    top = cells.nearest(cells.build(e, "vec_id", "v"), q, "v", 10)
    return top.groupBy("query_id").agg(F.count_if(F.col("label") == 1).alias("ones"), (F.count_if(F.col("label") == 1) >= 5).alias("block"))


@query(
    "k04_local_win_chance",
    f"WITH {KNN}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS k FROM p), t AS (SELECT query_id, label, sqrt(round(d, 9)) AS d, max(sqrt(round(d, 9))) OVER (PARTITION BY query_id) AS h FROM k WHERE k <= 20), w AS (SELECT query_id, label, (1 - (d / (h * 1.0001)) ** 3) ** 3 AS w FROM t) SELECT query_id, round(least(greatest(sum(w * (label % 2)) / sum(w), 0.05), 0.95), 5) AS chance FROM w GROUP BY 1",
)
def local_win_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tricube-weighted mean over the twenty nearest, from 0.05 to 0.95."""
    e = vectors(spark, sf_dir)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    top = nearest.neighbours(e, q, 20).withColumn("d", F.sqrt("distance"))
    t = top.withColumn("h", F.max("d").over(W.partitionBy("query_id")))
    w = (1 - (F.col("d") / (F.col("h") * 1.0001)) ** 3) ** 3
    return t.groupBy("query_id").agg(F.round(scalars.clip(F.sum(w * (F.col("label") % 2)) / F.sum(w), 0.05, 0.95), 5).alias("chance"))


@query("k02_kmeans")
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).where("z is not null and rsi is not null").select("symbol", "bar_no", (F.col("rsi") / 100).alias("a"), (F.col("stoch") / 100).alias("b"), F.concat_ws("/", "symbol", F.lpad(F.col("bar_no").cast("string"), 9, "0")).alias("id"))
    return models.kmeans(f, ["a", "b"], 3)[1].groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("a"), F.round(F.avg("b"), 6).alias("b"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete feature rows and whether the close is higher five bars on, as the estimators read them."""
    from pyspark.ml.feature import VectorAssembler

    f = features(spark, sf_dir).withColumn("later", F.lead("close", 5).over(W.partitionBy("symbol").orderBy("bar_no"))).where("later is not null")
    f = f.dropna().withColumn("label", (F.col("later") > F.col("close")).cast("double"))
    f = f.withColumn("place", (F.col("bar_no") - 1) / F.max("bar_no").over(W.partitionBy("symbol")))  # from 0 to 1 in its series
    f = staged(f, "labelled-features")  # fits read it again and again
    return VectorAssembler(inputCols=["z", "rsi", "stoch", "atr_pct"], outputCol="features").transform(f)


def scored(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    p = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(rows).withColumn("p", F.round(p, 6)).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("p") > 0.5) == (F.col("label") == 1)).cast("int")), 4).alias("accuracy"))


def in_time(rows: DataFrame, upto: float = 0.6, until: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Rows of the first part of each series, and those after it whose label does not look back into it."""
    later = rows.withColumn("gap", F.col("bar_no") - F.max(F.when(F.col("place") < upto, F.col("bar_no"))).over(W.partitionBy("symbol")))
    return rows.where(F.col("place") < upto), later.where((F.col("gap") > 5) & (F.col("place") < until)).drop("gap")


@query("k05_logistic")
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression

    train, test = in_time(labelled(spark, sf_dir))
    return scored(LogisticRegression(regParam=0.01, maxIter=30).fit(train), test)


@query("k05_softmax")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes (down, flat, up by half a percent five bars on) by the multinomial form."""
    from pyspark.ml.classification import LogisticRegression

    rows = labelled(spark, sf_dir)
    gain = F.col("later") / F.nullif(F.col("close"), F.lit(0.0)) - 1
    rows = rows.withColumn("label", F.when(gain > 0.005, 2.0).when(gain < -0.005, 0.0).otherwise(1.0))
    train, test = in_time(rows)
    model = LogisticRegression(regParam=0.01, maxIter=30, family="multinomial").fit(train)
    return model.transform(test).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 4).alias("accuracy"))


@query("k15_boosted_trees")
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.classification import GBTClassifier

    train, test = in_time(labelled(spark, sf_dir))
    return scored(GBTClassifier(maxIter=8, maxDepth=3, seed=7).fit(train), test)


@query("k16_isotonic")
def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration over five expanding folds in time, each a sixth of every series."""
    from pyspark.ml.regression import IsotonicRegression

    rows = labelled(spark, sf_dir).withColumn("rsi", F.col("rsi") / 100).drop("features").withColumnRenamed("rsi", "features")
    out = None
    for fold in range(1, 6):
        train, test = in_time(rows, fold / 6, (fold + 1) / 6)
        made = IsotonicRegression().fit(train).transform(test).agg(F.lit(fold).alias("fold"), F.count("*").alias("n"), F.round(F.avg((F.col("prediction") - F.col("label")) ** 2), 6).alias("brier"))
        out = made if out is None else out.unionByName(made)
    return out


@query("k20_tree_rules")
def tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a small tree as rules, with what they say on later rows."""
    from pyspark.ml.classification import DecisionTreeClassifier

    train, test = in_time(labelled(spark, sf_dir))
    model = DecisionTreeClassifier(maxDepth=3, minInstancesPerNode=50, seed=7, leafCol="leaf").fit(train)
    return model.transform(test).groupBy("leaf").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("rate"), F.first("prediction").alias("prediction"))


@query("k11_principal_components")
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of variance along each direction; the matrix of sums is all that is gathered."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=4, inputCol="f", outputCol="o").fit(vectors(spark, sf_dir).select(array_to_vector("v").alias("f")))
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(model.explainedVariance.toArray())], "component int, share double")


@query("k11_independent_components")
def independent_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector along four independent directions of variance 1."""
    v = vectors(spark, sf_dir)
    mean, matrix = components.independent(v, "v", 4)
    names = [f"c{i}" for i in range(1, len(matrix) + 1)]
    return components.projected(v, "v", mean, matrix, names).select("vec_id", *(F.round(c, 4).alias(c) for c in names))


@query("k11_mahalanobis")
def mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each vector is from the mean of all, in units of their spread, and whether it is among the far hundredth of a normal law."""
    d = components.distances(vectors(spark, sf_dir), "v", "distance")
    size = F.size("v")
    far = size * (1 - F.lit(2) / (9 * size) + 2.326 * F.sqrt(F.lit(2) / (9 * size))) ** 3  # the 99th percentile of chi-square, by cube roots
    return d.select("vec_id", F.round("distance", 5).alias("distance"), (F.col("distance") ** 2 > far).alias("far"))


@query(
    "k06_strict_auc",
    f"WITH {TRADES}, s AS (SELECT regime, quantity, count(*) FILTER (pnl > 0) AS p, count(*) FILTER (NOT pnl > 0) AS q FROM trades GROUP BY ALL), b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY regime ORDER BY quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) SELECT regime, round(sum(p * below) / nullif(sum(p) * sum(q), 0), 6) AS auc FROM b GROUP BY 1",
)
def strict_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.auc_strict(trades(spark, sf_dir).withColumn("win", F.col("pnl") > 0), "quantity", "win", ["regime"])


@query("k07_kalman")
def kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scans.scan(bars(spark, sf_dir), models.kalman(), ["level", "slope", "gain"], ["close"])
    return out.select("symbol", "bar_no", *(F.round(c, 6).alias(c) for c in ("level", "slope", "gain")))


@query("k07_factor_filter")
def factor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, volatility and momentum behind the returns of all symbols, hour by hour, and the regime that they say."""
    r = bars(spark, sf_dir).withColumn("ret", F.col("close") / prev("close") - 1).where("ret is not null")
    wide = r.groupBy("ts").pivot("symbol", models.MIX_ORDER).agg(F.first("ret"))
    series = wide.select(F.lit("all").alias("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).alias("bar_no"), *(F.col(c).alias(c) for c in models.MIX_ORDER))
    out = scans.scan(series, models.factors(), ["trend", "volatility", "momentum", "doubt"], models.MIX_ORDER)
    z = {c: F.round(c, 6).alias(c) for c in ("trend", "volatility", "momentum", "doubt")}
    regime = F.when(F.abs("trend") >= F.greatest(F.abs("volatility"), F.abs("momentum")), F.when(F.col("trend") > 0, "UP").otherwise("DOWN")).when(F.abs("volatility") >= F.abs("momentum"), "VOLATILE").otherwise("MOMENTUM")
    return out.select(F.timestamp_micros("bar_no").cast("timestamp_ntz").alias("ts"), *z.values(), regime.alias("regime"))


@query("k08_regulator")
def regulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of a regulator whose dynamics are estimated from the bars (four sums by symbol)."""
    b = bars(spark, sf_dir).select("symbol", "bar_no", (F.col("close") - F.avg("close").over(W.partitionBy("symbol"))).alias("x")).withColumn("x1", prev("x"))
    rows = b.where("x1 is not null").groupBy("symbol").agg((F.sum(F.col("x") * F.col("x1")) / F.sum(F.col("x1") ** 2)).alias("a")).collect()
    gain = lambda a: float(models.riccati(np.array([[a]]), np.array([[1.0]]), np.eye(1), 0.5 * np.eye(1))[1][0, 0])
    return spark.createDataFrame([(r["symbol"], round(r["a"], 6), round(gain(r["a"]), 6)) for r in rows], "symbol string, a double, gain double")


@query("k09_value_iteration")
def value_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best action by state from transition counts (as many rows as there are kinds of transitions)."""
    from tapewright.plans.ledger_queries import transitions

    rows = transitions(spark, sf_dir).collect()
    value, action = models.value_iteration({(r["s"], r["a"], r["s2"]): (r["n"], r["reward"]) for r in rows})
    return spark.createDataFrame([(s, action[s], round(value[s], 6)) for s in sorted(action)], "state string, action string, value double")


@query(
    "k12_half_life",
    f"WITH {BARS}, x AS (SELECT symbol, close AS y, {lag('close')} AS x FROM bars), g AS (SELECT symbol, count(x) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x WHERE x IS NOT NULL GROUP BY 1) SELECT symbol, n, round(b, 6) AS beta, round(CASE WHEN b > 0 AND b < 1 THEN least(greatest(ln(2) / -ln(b), 0.5), 500) END, 5) AS half_life, round(a / nullif(1 - b, 0), 5) AS level FROM g",
)
def half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bars(spark, sf_dir).select("symbol", F.col("close").alias("y"), prev("close").alias("x")).where("x is not null")
    g = x.groupBy("symbol").agg(F.count("x").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    inside = (F.col("b") > 0) & (F.col("b") < 1)
    half = F.when(inside, scalars.clip(F.log(F.lit(2.0)) / -F.log(F.when(inside, F.col("b"))), 0.5, 500.0))
    return g.select("symbol", "n", F.round("b", 6).alias("beta"), F.round(half, 5).alias("half_life"), F.round(F.col("a") / F.nullif(1 - F.col("b"), F.lit(0.0)), 5).alias("level"))


@query(
    "k13_decay_rate",
    f"WITH {TRADES}, y AS (SELECT strategy, year(exit_ts) - 1995 AS t, avg(r) + 5 AS s FROM trades GROUP BY ALL), g AS (SELECT strategy, count(*) AS n, regr_slope(ln(s), t) AS k, regr_intercept(ln(s), t) AS c FROM y WHERE s > 0 GROUP BY 1) SELECT strategy, n, round(-k, 6) AS rate, round(exp(c), 6) AS start, CASE WHEN -k > 0.1 THEN 'FAST' WHEN -k > 0.01 THEN 'SLOW' ELSE 'STABLE' END AS level FROM g",
)
def decay_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponential through yearly results, by a line through their logarithms."""
    y = trades(spark, sf_dir).groupBy("strategy", (F.year("exit_ts") - 1995).alias("t")).agg((F.avg("r") + 5).alias("s")).where("s > 0").withColumn("ls", F.log("s"))
    g = y.groupBy("strategy").agg(F.count("*").alias("n"), F.regr_slope("ls", "t").alias("k"), F.regr_intercept("ls", "t").alias("c"))
    return g.select("strategy", "n", F.round(-F.col("k"), 6).alias("rate"), F.round(F.exp("c"), 6).alias("start"), F.when(-F.col("k") > 0.1, "FAST").when(-F.col("k") > 0.01, "SLOW").otherwise("STABLE").alias("level"))


@query("k14_outcome_quantiles", f"WITH {TRADES} SELECT strategy, regime, round(quantile_cont(r, 0.1), 6) AS p10, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.9), 6) AS p90 FROM trades GROUP BY ALL")
def outcome_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional quantiles by cell."""
    q = order_stats.quantiles(trades(spark, sf_dir), "r", ["strategy", "regime"], {f"p{p}": p / 100 for p in (10, 50, 90)})
    return q.select("strategy", "regime", *(F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")))


@query("k14_quantile_regression")
def quantile_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result on quantity at three quantiles, by strategy."""
    lines = models.quantile_lines(trades(spark, sf_dir), "quantity", "r", ["strategy"], [0.1, 0.5, 0.9])
    return lines.select("strategy", "tau", F.round("intercept", 4).alias("intercept"), F.round("slope", 5).alias("slope"))


def ledger_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with what is known at their start, as numbers; ``late`` are those of the last fifth of days."""
    t = trades(spark, sf_dir)
    t = t.select("strategy", (F.col("pnl") / 1000).alias("result"), "quantity", "notional", F.datediff("exit_ts", "entry_ts").alias("days"), F.substring("regime", 1, 1).cast("int").alias("priority"), F.month("entry_ts").alias("month"), F.ascii("strategy").alias("kind"), F.unix_date(F.to_date("exit_ts")).alias("day"))
    ends = t.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    return t.join(F.broadcast(ends)).withColumn("late", F.col("day") > F.col("a") + 0.8 * (F.col("z") - F.col("a"))).drop("a", "z", "day")


BOOSTED = ["quantity", "notional", "days", "priority", "month", "kind"]


@query("k14_boosted_quantiles")
def boosted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the result by boosted trees fitted to earlier trades: their loss on later ones, and the share below each."""
    rows = staged(ledger_features(spark, sf_dir), "ledger-features")
    taus = [0.1, 0.5, 0.9]
    model = boosting.fit_quantiles(rows.where("not late"), BOOSTED, "result", taus, rounds=8)
    later = model.predict(rows.where("late"))
    made = F.explode(F.array(*(F.struct(F.lit(t).alias("tau"), boosting.pinball(F.col("result"), F.col(boosting.name(t)), t).alias("loss"), (F.col("result") <= F.col(boosting.name(t))).alias("below")) for t in taus))).alias("x")
    return later.select("strategy", made).groupBy("strategy", "x.tau").agg(F.count("*").alias("n"), F.round(F.avg("x.loss"), 6).alias("loss"), F.round(F.avg(F.col("x.below").cast("int")), 6).alias("below"))


TAUS = [0.3, 0.5, 0.7]


@query("k18_threshold_choice", f"WITH {TRADES}, p AS (SELECT (order_id * 37 + line_no * 11) % 100 / 100.0 AS p, r FROM trades), t AS (SELECT unnest({TAUS}) AS tau) SELECT tau, count(*) AS n, round(sum(r), 4) AS total, round(avg((r > 0)::INT), 6) AS win_rate FROM p JOIN t ON p >= tau GROUP BY 1")
def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.pmod(F.col("order_id") * 37 + F.col("line_no") * 11, F.lit(100)) / 100.0
    rows = trades(spark, sf_dir).select(p.alias("p"), "r").withColumn("tau", F.explode(F.array(*map(F.lit, TAUS)))).where("p >= tau")
    return rows.groupBy("tau").agg(F.count("*").alias("n"), F.round(F.sum("r"), 4).alias("total"), F.round(m.win_rate("r"), 6).alias("win_rate"))


@query("k10_policy_gradient")
def policy_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy over size, price and holding time learned from the ledger: where it began, where it went, and the mean result there."""
    t = ledger_features(spark, sf_dir)
    ends = t.agg(*(F.min(c).alias(f"{c}_a") for c in policy.ACTIONS), *(F.max(c).alias(f"{c}_z") for c in policy.ACTIONS))
    scaled = t.join(F.broadcast(ends)).select(*((F.col(c) - F.col(f"{c}_a")) / F.nullif(F.col(f"{c}_z") - F.col(f"{c}_a"), F.lit(0)).cast("double") for c in policy.ACTIONS), F.col("result")).toDF(*policy.ACTIONS, "reward")
    steps = policy.learn(scaled, policy.ACTIONS, "reward")
    first, last = steps[0], steps[-1]
    rows = [(c, round(first.mean[i], 6), round(last.mean[i], 6), round(first.value, 6), round(last.value, 6)) for i, c in enumerate(policy.ACTIONS)]
    return spark.createDataFrame(rows, "action string, start double, learned double, start_value double, learned_value double")


@query("k17_halving")
def halving_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 2,000 pairs of parameters for each symbol by successive halving, with its result on the bars kept back."""
    from tapewright.operators import simulate
    from tapewright.plans.simulation_queries import signals

    rows = staged(signals(spark, sf_dir), "signals")
    pairs = spark.range(2000).select((0.5 + F.floor(F.col("id") / 50) * 0.0625).alias("stop_mult"), (1.0 + (F.col("id") % 50) * 0.0625).alias("reward"))
    best = simulate.halving(rows, pairs, [0.1, 0.2, 0.6])
    later = rows.join(rows.groupBy("symbol").agg((F.max("bar_no") * 0.6).alias("cut")), "symbol").where("bar_no > cut").drop("cut")
    out = simulate.sweep(later, best.select("symbol", "stop_mult", "reward")).select("symbol", "stop_mult", "reward", F.col("total").alias("later"))
    return best.join(out, ["symbol", "stop_mult", "reward"], "left").select("symbol", "stop_mult", "reward", F.round("total", 6).alias("fit"), F.round(F.coalesce("later", F.lit(0.0)), 6).alias("later"))


@query("k17_grid_search")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best parameters on the first three fifths of the bars, with their result on the rest."""
    from tapewright.operators import simulate
    from tapewright.plans.simulation_queries import OHLC, signals

    steps = lambda a, b, n: F.explode(F.array(*(F.lit(a + (b - a) * i / (n - 1)) for i in range(n))))
    rows = signals(spark, sf_dir)
    grid = rows.withColumn("stop_mult", steps(0.5, 3.0, 6)).withColumn("reward", steps(1.0, 4.0, 7))
    cut = rows.groupBy("symbol").agg((F.max("bar_no") * 0.6).alias("cut"))
    t = simulate.trades_of(grid, ["symbol", "stop_mult", "reward"], OHLC, simulate.bracket()).withColumn("ret", (F.col("exit") / F.col("entry") - 1) * F.col("direction")).join(cut, "symbol")
    s = t.groupBy("symbol", "stop_mult", "reward").agg(F.coalesce(F.sum(F.when(F.col("exit_bar") <= F.col("cut"), F.col("ret"))), F.lit(0.0)).alias("fit"), F.round(F.coalesce(F.sum(F.when(F.col("entry_bar") > F.col("cut"), F.col("ret"))), F.lit(0.0)), 6).alias("later"))
    best = F.max_by(F.struct("stop_mult", "reward", F.round("fit", 6).alias("fit"), "later"), F.struct("fit", -F.col("stop_mult"), -F.col("reward"))).alias("b")
    return s.groupBy("symbol").agg(best).select("symbol", "b.*")


@query(
    "k19_unit_root",
    f"WITH {BARS}, d AS (SELECT symbol, close - {lag('close')} AS y, {lag('close')} AS x FROM bars), g AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS b, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se FROM d WHERE x IS NOT NULL GROUP BY 1) SELECT symbol, round(b / se, 5) AS t, b / se < -2.86 AS stationary FROM g",
)
def unit_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dickey-Fuller statistic of each series against its 5 % bound (with a constant, no lags)."""
    d = bars(spark, sf_dir).select("symbol", (F.col("close") - prev("close")).alias("y"), prev("close").alias("x")).where("x is not null")
    b = F.regr_slope("y", "x")
    g = d.groupBy("symbol").agg((b / F.sqrt((F.regr_syy("y", "x") - b * F.regr_sxy("y", "x")) / (F.count("*") - 2) / F.regr_sxx("y", "x"))).alias("t"))
    return g.select("symbol", F.round("t", 5).alias("t"), (F.col("t") < -2.86).alias("stationary"))


@query("k21_clean_portfolio")
def clean_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights from correlations freed of noise; moments of pairs of symbols are aggregated, the matrix is symbols squared."""
    r = bars(spark, sf_dir).select("symbol", "ts", (F.col("close") / prev("close") - 1).alias("r")).where("r is not null")
    two = r.join(r.select(F.col("symbol").alias("other"), "ts", F.col("r").alias("r2")), "ts")
    g = two.groupBy("symbol", "other").agg(m.correlation("r", "r2").alias("c"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.count("*").alias("n")).collect()
    names = sorted({x["symbol"] for x in g})
    at = {s: i for i, s in enumerate(names)}
    corr, mu, sd = np.eye(len(names)), np.zeros(len(names)), np.ones(len(names))
    for x in g:
        corr[at[x["symbol"]], at[x["other"]]] = x["c"] if x["c"] is not None else 0.0
        if x["symbol"] == x["other"]:
            mu[at[x["symbol"]]], sd[at[x["symbol"]]] = x["mu"], x["sd"]
    cleaned = models.clean_correlation((corr + corr.T) / 2, len(names) / max(x["n"] for x in g)) * np.outer(sd, sd)
    weights = np.clip(np.linalg.solve(cleaned, mu), -1, 1)
    return spark.createDataFrame([(s, round(float(w), 6)) for s, w in zip(names, weights, strict=True)], "symbol string, weight double")


@query("k22_look_ahead")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators recomputed on series cut at ten places: rows at the cut that differ from those of the whole series."""
    from tapewright.functions import indicators as ind

    b = staged(bars(spark, sf_dir), "bars")
    tests = {"sma": ind.sma, "rsi": ind.rsi, "stochastic": ind.stochastic, "bollinger": ind.bollinger, "donchian": ind.donchian, "roc": ind.roc, "swing_points": ind.swing_points}
    cuts = b.groupBy("symbol").agg(F.max("bar_no").alias("n")).select("symbol", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("cut"), "n").select("symbol", "cut", F.ceil(F.col("n") * F.col("cut") / 10).alias("end"))
    # each cut is a series of its own, so all are computed at once
    early = b.join(F.broadcast(cuts), "symbol").where("bar_no <= end").withColumn("symbol", F.concat_ws("|", "symbol", F.col("cut").cast("string")))
    marks = cuts.withColumn("name", F.concat_ws("|", "symbol", F.col("cut").cast("string")))
    out = None
    for name, f in tests.items():
        whole = f(b).select("symbol", F.col("bar_no").alias("end"), F.col("raw").alias("raw0"))
        part = f(early.drop("cut", "end")).select(F.col("symbol").alias("name"), F.col("bar_no").alias("end"), "raw")
        both = F.broadcast(marks).join(whole, ["symbol", "end"]).join(part, ["name", "end"])
        row = both.groupBy("cut").agg(F.count_if(~F.col("raw0").eqNullSafe(F.col("raw"))).alias("differ")).select(F.lit(name).alias("indicator"), "cut", "differ")
        out = row if out is None else out.unionByName(row)
    return out

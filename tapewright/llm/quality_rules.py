"""Quality rules: decision lists learned by sequential covering, applied as ordered Spark conditional expressions.

Text statistics are made by DataFrame functions alone. Learning reads statistics of labelled documents: Spark cuts
every feature at its quantiles (halfway to the next value that occurs) and counts good and bad documents for each
combination of cut features; from those counts conjunctions of thresholds are grown by information gain on one part of
the labels, pruned on the other, and added while they stay precise there, each rule covering what the rules before it
left. The list becomes one ``CASE WHEN`` in rule order.

At most ``max_labelled`` labelled documents (those with the smallest hashed ids) are used for fitting; statistics and
verdicts cover every document and its whole text.

Defined results: a null text counts as an empty one (no words, so the base rules reject it); very long texts are
counted whole; repeated rows are judged alike, row by row; of several labels of a key the worst counts; features equal
to a cut lie below it; without labels, or with labels of one class, there are no learned rules and the base rules alone
decide; an empty table gives an empty result; columns named like a statistic are replaced, others pass through whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import others, require, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SEGMENT = 100  # words over which different ones are counted, so that the rate does not fall with a text's length
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "distinct_rate")


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def n_repeat_words(windows: Column) -> Column:
    """Words inside windows (given by their hashes in text order) that occur twice or more.

    Equal windows are neighbours once sorted; the positions of such windows, in order, cover up to five words each
    and no word twice.
    """
    at = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        hit = F.filter(F.transform(s, lambda x, k: F.when(F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)), x["i"])), lambda p: p.isNotNull())
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("p"))
        return F.aggregate(
            F.sort_array(hit),
            start,
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["p"]).cast("long")).alias("n"), p.cast("int").alias("p")),
            lambda a: a["n"],
        )

    bound = F.get(F.transform(F.array(at), repeated), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(bound)


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` and the statistics of the whole text (long) and the learner's features (double)."""
    require(df, [text])
    t = F.col("_text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = df.select(F.struct(*others(df, *STATISTICS, *FEATURES)).alias("_given"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kept = ["_given"]  # in one column, so that no name of theirs meets one of the statistics' own
    out = out.select(*kept, "_text", words.alias("_words"), lines.alias("_lines"))
    out = out.select(*kept, "_text", "_lines", F.size("_words").cast("long").alias("n_words"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    h = lambda i, k: F.get(F.col("_hashes"), i + k)
    windows = F.when(F.size("_hashes") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(*(h(i, k) for k in range(WINDOW))))).otherwise(F.array().cast("array<long>"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_hashes") - 1, F.lit(0)), F.lit(SEGMENT))
    distinct = F.aggregate(starts, F.lit(0), lambda n, i: n + F.size(F.array_distinct(F.slice("_hashes", i + 1, SEGMENT))))
    out = out.select(*kept, "_text", "_lines", "n_words", distinct.alias("_distinct"), windows.alias("_windows"))
    out = out.select(
        *kept,
        "n_words",
        "_distinct",
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        count_chars(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("_n_lines"),
        n_repeat_words(F.col("_windows")).alias("n_repeat_words"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).alias("_upper"),
        count_chars(F.col("_text"), "!?").alias("_marks"),
    )
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return out.select(
        "_given.*",
        *STATISTICS,
        rate("word_chars", "n_words").alias("mean_word"),
        rate("n_symbols", "n_words").alias("symbol_rate"),
        rate("n_dup_lines", "_n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("_upper", "word_chars").alias("upper_rate"),
        rate("_marks", "n_words").alias("mark_rate"),
        rate("_distinct", "n_words").alias("distinct_rate"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    precision: float
    support: int

    def column(self) -> Column:
        out = F.lit(True)
        for x in self.literals:
            out = out & x.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{x.feature} {'>' if x.above else '<='} {x.cut:g}" for x in self.literals)


def cells(stats: DataFrame, labels: DataFrame, key: str, label: str, cuts: int) -> tuple[dict[str, list[float]], list[tuple]]:
    """The cut points of every feature, and (bins..., part, bad, rows) for each combination that occurs."""
    rows = written(stats.join(F.broadcast(labels), key).select(key, label, *FEATURES), "labelled")
    steps = [i / cuts for i in range(1, cuts)]
    found = rows.agg(*(F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES)).first()
    seen = {f: sorted({float(x) for x in found[f] or []}) for f in FEATURES}
    after = rows.agg(*(F.array(*(F.min(F.when(F.col(f) > c, F.col(f))) for c in seen[f])).alias(f) for f in FEATURES)).first()
    # a cut lies halfway to the next value that occurs, so that it is no closer to one side than to the other
    points = {f: sorted({(c + float(n)) / 2 for c, n in zip(seen[f], after[f], strict=True) if n is not None}) for f in FEATURES}
    bins = [sum(((F.col(f) > c).cast("int") for c in points[f]), F.lit(0)).alias(f) for f in FEATURES]
    binned = rows.select(*bins, (F.pmod(F.xxhash64(key, F.lit(1)), F.lit(3)) == 0).alias("part"), (F.col(label) == 0).cast("int").alias("bad"))
    counted = binned.groupBy(*FEATURES, "part").agg(F.sum("bad").alias("bad"), F.count("*").alias("rows"))
    return points, [tuple(r) for r in counted.collect()]  # no more rows than labelled documents used


def grow(rows: list[tuple], points: dict[str, list[float]], most: int) -> list[tuple[int, bool, int]]:
    """Conditions (feature, above, cut index) added one by one by FOIL's gain until only bad rows are left."""
    conditions: list[tuple[int, bool, int]] = []
    while len(conditions) < most:
        p0, n0 = sum(r[-2] for r in rows), sum(r[-1] for r in rows)
        if not p0 or p0 == n0:
            break
        best, gain = None, 1e-9
        for f, name in enumerate(FEATURES):
            size = len(points[name]) + 1
            bad, every = [0] * size, [0] * size
            for r in rows:
                bad[r[f]] += r[-2]
                every[r[f]] += r[-1]
            p = n = 0
            for cut in range(size - 1):
                p, n = p + bad[cut], n + every[cut]
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if a and (g := a * (math.log2(a / b) - math.log2(p0 / n0))) > gain:
                        best, gain = (f, above, cut), g
        if best is None:
            break
        conditions.append(best)
        rows = covered(rows, [best])
    return conditions


def covered(rows: list[tuple], conditions: Sequence[tuple[int, bool, int]]) -> list[tuple]:
    return [r for r in rows if all((r[f] > cut) == above for f, above, cut in conditions)]


def counts(rows: list[tuple], conditions: Sequence[tuple[int, bool, int]]) -> tuple[int, int]:
    got = covered(rows, conditions)
    return sum(r[-2] for r in got), sum(r[-1] for r in got)


def prune(rows: list[tuple], options: list[list[tuple[int, bool, int]]]) -> list[tuple[int, bool, int]]:
    """Of a rule's prefixes the one that does best on rows it was not grown on, the shorter one at a tie."""

    def worth(conditions: list[tuple[int, bool, int]]) -> tuple[float, int]:
        p, n = counts(rows, conditions)
        return ((p + 1) / (n + 2) if n else 0.0, -len(conditions))

    return max(options, key=worth, default=[])


def used_labels(labels: DataFrame, key: str, label: str, max_labelled: int) -> DataFrame:
    """One label for each key (the worst of several), at most ``max_labelled``: those with the smallest hashed keys."""
    require(labels, [key, label])
    known = labels.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(key).agg(F.min(label).alias(label)).orderBy(F.xxhash64(key), key).limit(max_labelled)


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_labelled: int = 20_000, cuts: int = 32, max_rules: int = 16, max_literals: int = 4, min_precision: float = 0.95, min_support: int = 5) -> list[Rule]:
    """Learn rules that find rows with ``label`` 0 among ``stats`` (made by ``with_statistics``)."""
    points, rows = cells(stats, used_labels(labels, key, label, max_labelled), key, label, cuts)
    growing, holding = [r for r in rows if not r[-3]], [r for r in rows if r[-3]]
    rules: list[Rule] = []

    def precise(conditions: list[tuple[int, bool, int]]) -> bool:
        (p, n), (hp, hn) = counts(growing, conditions), counts(holding, conditions)
        return n + hn >= min_support and p + hp >= min_precision * (n + hn) and hn > 0 and hp >= min_precision * hn

    while len(rules) < max_rules and growing:
        grown = grow(growing, points, max_literals)
        conditions = prune(holding, [grown[:k] for k in range(1, len(grown) + 1) if precise(grown[:k])])
        if not conditions:
            break
        got, held = covered(growing, conditions), covered(holding, conditions)
        p, n = (x + y for x, y in zip(counts(growing, conditions), counts(holding, conditions), strict=True))
        literals = tuple(Literal(FEATURES[f], above, points[FEATURES[f]][cut]) for f, above, cut in conditions)
        rules.append(Rule(literals, p / n, n))
        gone = {*got, *held}
        growing, holding = ([r for r in part if r not in gone] for part in (growing, holding))
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The number of the first rule that fits, from 1, in rule order; null where none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), F.lit(i)).otherwise(out)
    return out


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = 20_000, **how: object) -> DataFrame:
    """``df`` with statistics, ``base_failed``, ``failed_rule`` and ``kept``; only labelled rows are read in full twice."""
    require(df, [key, text])
    mine = others(df, "base_failed", "failed_rule", "kept")
    used = written(used_labels(labels, key, label, max_labelled), "labels-used")
    labelled = df.select(key, text).join(F.broadcast(used.select(key)), key, "left_semi")  # no more than max_labelled keys
    rules = fit(with_statistics(labelled, text), used, key, label, max_labelled, **how)
    out = with_statistics(df.select(*mine), text).withColumn("base_failed", base_failed()).withColumn("failed_rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def keep(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", **how: object) -> DataFrame:
    """The rows of ``df`` that the base rules and the learned rules keep.

    The verdict goes through a one-element array: a filter on it is not moved below the statistics, where Catalyst
    would copy their expressions into it many times over.
    """
    judged = judge(df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct("*").alias("given")), labels.select(F.col(key).alias("key"), F.col(label).alias("label")), "key", "text", "label", **how)
    return judged.select("given", F.explode(F.array("kept")).alias("keep")).where("keep").select("given.*")

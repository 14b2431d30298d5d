"""Benchmark decontamination by winnowing: least k-gram hashes of sliding windows, joined and extended to whole spans.

A text's fingerprints are the least hash of each run of ``span - k + 1`` neighbouring k-grams. Two texts that share
``span`` words in a row share all k-grams within them, so the least of these is a fingerprint of both: every shared
span is found, with about two fingerprints for each ``(span - k + 2)`` words. The distinct fingerprints of documents
are joined to those of benchmark items; around each place of a hit the spans that hold it are compared word by word
with the benchmark's, so hash collisions never count. Items shorter than ``span`` are one span of their own length,
with shorter windows for it.

Everything is a DataFrame expression or join. Documents with the same set of found spans have their item lists made
once, so that a passage in a third of all documents is one list.

Defined results: null and empty texts have no words; texts of any length are searched whole, repeated rows alike, row by
row; equal windows of an item count once; items with the same id are one item, an item without an id is listed as an
empty string; items without words and an empty benchmark hit nothing; an empty table gives an empty result; columns
named like results are replaced, others pass through whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import join_counted, others, require, tidy, written

RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits")
AROUND = "array<struct<at:int,span:int,window:array<string>>>"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text in lower case; only A-Z change."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def neighbours(values: Column, n: int, make) -> Column:
    """``make`` of each ``n`` neighbouring elements; none if there are fewer."""
    at = lambda i: make([F.get(values, i + j) for j in range(n)])
    return F.when(F.size(values) >= n, F.transform(F.sequence(F.lit(0), F.size(values) - n), at)).otherwise(F.array().cast("array<bigint>"))


def with_grams(df: DataFrame, words: str, spans: list[int], k: int) -> DataFrame:
    """``df`` with a column ``grams_n`` for each length n of k-grams that the spans need."""
    kept = df.columns
    df = df.select("*", F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))
    return df.select(*kept, *(neighbours(F.col("hashes"), n, lambda x: F.xxhash64(*x)).alias(f"grams_{n}") for n in sorted({min(k, s) for s in spans})))


def fingerprints(spans: list[int], k: int) -> Column:
    """Distinct fingerprints, from the columns of ``with_grams``, for windows of all the spans."""
    least = lambda x: F.least(*x) if len(x) > 1 else x[0]
    found = [neighbours(F.col(f"grams_{min(k, s)}"), s - min(k, s) + 1, least) for s in spans]
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<bigint>")


def benchmark_windows(items: DataFrame, item_id: str, text: str, span: int) -> DataFrame:
    """Distinct windows of all items: their words, and the ids of the items that hold them."""
    made = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - span, F.lit(0))), lambda i: F.slice("words", i + 1, span))
    windows = made.select("item", F.explode(cut).alias("window"))
    return windows.groupBy("window").agg(F.collect_set("item").alias("items"))


def spans_around(grams: Column, span: int, k: int) -> Column:
    """The spans (place, length, words) of ``words`` that hold a k-gram whose hash is in ``met``."""
    hit = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains("met", g), i)), lambda i: i.isNotNull())
    starts = F.transform(hit, lambda p: F.sequence(F.greatest(p - (span - k), F.lit(0)), F.least(p, F.size("words") - span)))
    cut = F.transform(F.array_distinct(F.flatten(starts)), lambda a: F.struct(a.alias("at"), F.lit(span).alias("span"), F.slice("words", a + 1, span).alias("window")))
    return F.when(F.size("words") >= span, cut).otherwise(F.array().cast(AROUND))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside windows of items), n_items, items_sha256, contaminated and ``hits``.

    ``hits`` has place and length, in words, of every window of an item that the text holds, in order.
    """
    require(docs, [text])
    require(items, [item_id, item_text])
    with tidy(docs.sparkSession):
        return _decontaminate(docs, items, text, item_id, item_text, span, k)


def _decontaminate(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, span: int, k: int) -> DataFrame:
    windows = written(benchmark_windows(items, item_id, item_text, span).select(F.monotonically_increasing_id().alias("window_id"), "window", F.size("window").alias("span"), "items"), "item-windows")
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())  # at most ``span`` different numbers
    n_windows = windows.count()
    by_span = [fingerprints([s], k) for s in spans]
    prints = with_grams(windows.select("window", "span"), "window", spans, k)
    chosen = F.coalesce(*(F.when(F.col("span") == s, f) for s, f in zip(spans, by_span, strict=True))) if spans else F.array().cast("array<bigint>")
    wanted = written(prints.select(F.explode(chosen).alias("print")).distinct(), "item-prints")

    given = F.struct(*others(docs, *RESULTS)).alias("given")
    rows = docs.select(given, F.col(text).alias("text"), words_of(F.col(text)).alias("words"))
    rows = with_grams(rows, "words", spans, k).select(F.monotonically_increasing_id().alias("row"), "given", "text", F.size("words").cast("long").alias("n_words"), fingerprints(spans, k).alias("prints"))
    rows = written(rows, "fingerprints", keep=True)
    met = join_counted(rows.select("row", F.explode("prints").alias("print")), wanted, ["print"], "inner", wanted.count())
    met = written(met.groupBy("row").agg(F.collect_set("print").alias("met")), "rows-met")

    # the spans around each place of a hit, compared with the items' own
    near = join_counted(rows.select("row", "text"), met, ["row"], "inner", met.count()).select("row", "met", words_of(F.col("text")).alias("words"))
    near = with_grams(near, "words", spans, k)
    around = [spans_around(F.col(f"grams_{min(k, s)}"), s, min(k, s)) for s in spans]
    whole = F.concat(*around) if around else F.array().cast(AROUND)
    spread = near.select("row", F.explode(whole).alias("c")).select("row", "c.at", "c.span", "c.window")
    found = join_counted(spread, windows.select("window", "window_id"), ["window"], "inner", n_windows)
    marked = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "span"))).alias("hits"), F.sort_array(F.collect_set("window_id")).alias("windows"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["at"] + h["span"] - F.greatest(a["end"], h["at"]))).cast("long").alias("n"), F.greatest(a["end"], h["at"] + h["span"]).alias("end"))
    covered = F.aggregate("hits", start, step, lambda a: a["n"])
    marked = written(marked.select("row", "hits", covered.alias("n_hit"), "windows", F.sha2(F.array_join(F.transform("windows", lambda x: x.cast("string")), ","), 256).alias("set_id")), "rows-hit", keep=True)

    # item lists once for each different set of windows
    sets = marked.groupBy("set_id").agg(F.any_value("windows").alias("windows"))
    listed = join_counted(sets.select("set_id", F.explode("windows").alias("window_id")), windows.select("window_id", "items"), ["window_id"], "inner", n_windows)
    listed = listed.select("set_id", F.explode("items").alias("item")).groupBy("set_id").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    listed = written(listed.select("set_id", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "item-lists", keep=True)
    told = join_counted(marked.drop("windows"), listed, ["set_id"], "inner", listed.count()).drop("set_id")

    none = F.sha2(F.lit(""), 256)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = join_counted(rows.drop("text", "prints"), told, ["row"], "left", marked.count())
    return out.select("given.*", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("hits", F.array().cast("array<struct<at:int,span:int>>")).alias("hits"))

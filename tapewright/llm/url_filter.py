"""URL filters: written rules by host and path, and rules mined from labelled URLs by Spark's FP-growth.

A URL is a set of tokens (scheme, host labels, host, registered name, path segments, file ending, query keys). Tokens
that the same labelled URLs have are one item, so that a long path that always comes whole is one item and not as many
as make 2^k sets of one meaning. A URL of more than ``most_items`` items is mined in parts: its items, those that say most about
the label first, are cut into runs, and every ``set_size`` runs are mined together, so that every set of up to ``set_size``
items is found, and of larger ones those within so many runs; support is lowered by as much as parts outnumber URLs. The item sets it finds with the label are counted again on all items of
all labelled URLs; those of enough confidence and support and better than each of their subsets are kept as rules. They are matched through an inverted index: tokens give the items
of a URL, each rule is filed under its rarest item, and a candidate counts if the URL has (a token of) all its items.

Defined results: a null URL or one without ``://`` has an empty host and path, no tokens, and is allowed; URLs of any
length are read whole; equal URLs get equal verdicts; of several labels of a key the worst counts; of rules that fit
the surest, at a tie the last in order of items, is named; without labels nothing is mined and only the written rules
decide; an empty table gives an empty result; columns with the names of results are replaced, others pass through
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import join_counted, others, require, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BAD = "label=block"
Rules = Sequence[tuple[str, str, str]]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL."""
    named = lambda kind, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind + "="), p))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    all_tokens = F.concat(
        named("scheme", F.array(F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        named("host", F.array(host)),
        named("label", F.split(host, r"\.")),
        named("name", F.array(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))),
        named("segment", F.split(path, "/")),
        named("ending", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
        named("key", F.transform(F.split(query, "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)))),
    )
    return F.when(host != "", F.array_distinct(all_tokens)).otherwise(F.array().cast("array<string>"))


def written_rule(host: Column, path: Column, rules: Rules) -> Column:
    """(rule, verdict) of the longest rule, given as (verdict, host, path start), that fits; nulls where none does."""
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    out = none
    for said, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(said).alias("verdict"))).otherwise(out)
    return out


EMPTY = "id long, items array<string>, filed_under string, confidence double, support double"


def items_of(labelled: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """(item, token, n, n_bad) for the tokens of at least ``min_rows`` rows, and (bad, items) for each row, those that say most first.

    Rows are told apart by ``row``; the tokens of an item are in the same rows, and it is named after the least one.
    """
    each = labelled.select("row", "bad", F.explode("tokens").alias("token"))
    same = (F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    tokens = written(each.groupBy("token").agg(*same).where(F.col("n") >= min_rows), "tokens")
    named = tokens.groupBy("n", "n_bad", "x", "y").agg(F.min("token").alias("item"))
    index = written(tokens.join(named, ["n", "n_bad", "x", "y"]).select("item", "token", "n", "n_bad"), "items")
    total = labelled.agg(F.count("*").alias("total"), F.count_if("bad").alias("total_bad"))
    said = F.abs(F.col("n_bad") - F.col("n") * F.col("total_bad") / F.col("total"))  # rows more, or fewer, than a token without meaning has
    worth = index.where("item = token").join(F.broadcast(total)).select("item", said.alias("said"))
    ranked = each.join(worth, each["token"] == worth["item"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("said")).alias("s"), "item"))).alias("ranked"))
    items = F.coalesce(F.col("ranked.item"), F.array().cast("array<string>"))
    return index, labelled.select("row", "bad").join(ranked, "row", "left").select("bad", items.alias("items"))


def parts_of(items: Column, most_items: int, set_size: int) -> Column:
    """``items`` whole if they are ``most_items`` or fewer, else every ``set_size`` of the runs that they are cut into."""
    run = max(1, most_items // set_size)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / run).cast("int")), lambda i: F.slice(items, i * run + 1, run))
    above = lambda i: F.when(i + 1 < F.size(runs), F.sequence(i + 1, F.size(runs) - 1)).otherwise(F.array().cast("array<int>"))

    def chosen(i: Column, left: int) -> Column:
        mine = F.get(runs, i)
        return F.array(mine) if not left else F.flatten(F.transform(above(i), lambda j: F.transform(chosen(j, left - 1), lambda more: F.concat(mine, more))))

    return F.when(F.size(items) <= most_items, F.array(items)).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs) - 1), lambda i: chosen(i, set_size - 1))))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_rows: int = 10, most_items: int = 12, set_size: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rules (id, items, filed_under, confidence, support) from rows of ``tokens`` and ``bad`` (boolean), and (item, token)."""
    rows = written(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled-urls")
    n = rows.count()
    spark = labelled.sparkSession
    if not n:
        return spark.createDataFrame([], EMPTY), spark.createDataFrame([], "item string, token string")
    share = min(1.0, max(min_support, min_rows / n))
    index, each = items_of(rows, math.ceil(share * n - 1e-9))
    parts = written(each, "items-of-urls").select("bad", F.explode(parts_of(F.col("items"), most_items, set_size)).alias("items"))
    baskets = written(parts.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "baskets")
    n_parts = baskets.count()
    # parts of one URL repeat its sets, so then only support says what is frequent; confidence is counted on whole URLs below
    model = FPGrowth(itemsCol="items", minSupport=share * n / n_parts, minConfidence=min_confidence if n_parts == n else 0.0).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD)).select(F.array_sort("antecedent").alias("items"))
    counted = index.where("item = token").select("item", "n")
    each = found.select("items", F.explode("items").alias("item")).join(counted, "item").groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("filed_under"))
    proposed = written(each.select(F.xxhash64("items").alias("id"), "items", "filed_under"), "proposed-rules")
    # what a rule covers is counted on all items of all rows
    covers = fitting(rows.select("row", "bad", "tokens"), ["row", "bad"], proposed, index).groupBy("id").agg(F.count("*").alias("rows"), F.count_if("bad").alias("bad"))
    sure = covers.select("id", (F.col("bad") / F.col("rows")).alias("confidence"), (F.col("bad") / n).alias("support"))
    exact = written(proposed.join(sure, "id").where((F.col("confidence") >= min_confidence) & (F.col("support") >= share - 1e-12)), "rules")
    # a rule is dropped if one of its subsets, with one item less, is at least as confident
    less = exact.select(F.col("id").alias("of"), F.col("confidence").alias("c"), F.explode(F.transform("items", lambda x: F.xxhash64(F.array_remove("items", x)))).alias("id"))
    beaten = less.join(exact.select("id", F.col("confidence").alias("sub")), "id").where("sub >= c").select(F.col("of").alias("id")).distinct()
    rules = written(exact.join(beaten, "id", "left_anti").select("id", "items", "filed_under", "confidence", "support"), "url-rules")
    return rules, written(index.join(rules.select(F.explode("items").alias("item")).distinct(), "item", "left_semi").select("item", "token"), "rule-items")


def fitting(rows: DataFrame, key: list[str], rules: DataFrame, index: DataFrame) -> DataFrame:
    """``key`` and the rules' columns for each row of ``tokens`` and each rule whose items it all has, by inverted index."""
    each = rows.select(*key, F.explode("tokens").alias("token"))
    held = join_counted(each, index.select("item", "token"), ["token"], "inner", index.count()).groupBy(*key).agg(F.collect_set("item").alias("held"))
    met = join_counted(held.select(*key, "held", F.explode("held").alias("filed_under")), rules, ["filed_under"], "inner", rules.count())
    return met.where(F.size(F.array_except("items", "held")) == 0).drop("held")


def matches(urls: DataFrame, rules: DataFrame, index: DataFrame) -> DataFrame:
    """(url, mined, confidence) for distinct URLs that at least one mined rule fits."""
    distinct = urls.where(F.size("tokens") > 0).select("url", "tokens").distinct()
    best = fitting(distinct, ["url"], rules, index).groupBy("url").agg(F.max(F.struct("confidence", "items")).alias("best"))
    return best.select("url", F.col("best.items").alias("mined"), F.col("best.confidence").alias("confidence"))


def judge(df: DataFrame, url: str, rules: Rules, labels: DataFrame, key: str, label_key: str, label: str = "quality", **how: float) -> DataFrame:
    """``df`` with host, path, rule, verdict, and the mined tokens and their confidence where those decided."""
    require(df, [url, key])
    given = F.struct(*others(df, "host", "path", "rule", "verdict", "mined", "confidence")).alias("given")
    parts = df.select(given, F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    tokens = parts.select("key", "url", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    known = labels.select(F.col(label_key).alias("key"), (F.col(label) == 0).alias("bad")).where("key is not null and bad is not null").groupBy("key").agg(F.max("bad").alias("bad"))
    found = written(matches(tokens, *mine(tokens.join(known, "key").select("tokens", "bad"), **how)), "url-matches")
    out = parts.withColumn("said", written_rule(F.col("host"), F.col("path"), rules)).join(found, "url", "left")
    said = F.coalesce(F.col("said.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select("given.*", "host", "path", F.col("said.rule").alias("rule"), said.alias("verdict"), "mined", "confidence")

"""Line dedup by a deletion-neighbourhood join.

A line goes if an equal line, or one within one edit (a character inserted, deleted or replaced), comes earlier in the
corpus, however short the lines are; lines are ordered by doc_id, then by their number in the text, then (texts of one doc_id) by
the text's hash. Lines without a word always stay. With ``least_chars`` only lines of which one is that long are compared for edits.

How: equal lines are counted by hash. Two lines within one edit share the first or the second half (of the shorter
one), so only lines of which another line shares a half can have a partner; the whole corpus is screened for that.
For these lines every variant with one character deleted is emitted as a hashed key: with its position for replaced
characters, so that all lines of a key are within one edit of each other, and without it, with the undeleted lines,
for inserted ones. A key's earliest line is then compared with every other one, so groups are
aggregated before they are joined and never paired out.

Defined results: a null text stays null; doc_ids are of any type that has an order, and a null one comes first; rows equal in doc_id and text count as one document
and keep the same lines, other texts of one (or no) doc_id are documents of their own; texts and lines of any length
are taken whole; a text may become empty, its row stays; an empty table gives an empty result; other columns pass
through, whatever their names, and those named ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import SMALL_ROWS, fresh, join_counted, others, require, written

SPACES = " \t\n\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
EMIT_ROWS = 50_000
REPLACED, DELETED, WHOLE = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def variant_keys(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and kinds of a line: one for each position replaced, each distinct deletion, and the whole line."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(codes)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes + np.uint64(1)) * _powers(BASE, n), dtype=np.uint64)])
        whole = sums[-1]
        cut = sums[:-1] + (whole - sums[1:]) * BASE_INVERSE
        place = np.arange(n, dtype=np.uint64)
        replaced = _mix(cut + _mix(place * np.uint64(3) + np.uint64(7)) + np.uint64(n))
        deleted = np.unique(_mix(cut ^ np.uint64(0xA5A5A5A5A5A5A5A5)) + np.uint64(n - 1))
        uncut = _mix(whole ^ np.uint64(0xA5A5A5A5A5A5A5A5)) + np.uint64(n)
    keys = np.concatenate([replaced, deleted, [uncut]]).view(np.int64)
    kinds = np.concatenate([np.full(n, REPLACED), np.full(len(deleted), DELETED), [WHOLE]]).astype(np.int8)
    return keys, kinds


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (key, kind, rank) for each variant of each line, in batches of bounded size."""
    for batch in batches:
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        n = 0
        for rank, line in zip(batch.column("rank").to_pylist(), batch.column("line").to_pylist(), strict=True):
            keys, kinds = variant_keys(line)
            for at in range(0, len(keys), EMIT_ROWS):
                held.append((keys[at : at + EMIT_ROWS], kinds[at : at + EMIT_ROWS], rank))
                n += len(held[-1][0])
                if n >= EMIT_ROWS:
                    yield _joined(held)
                    held, n = [], 0
        if held:
            yield _joined(held)


def _joined(held: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    ranks = np.repeat([r for _, _, r in held], [len(k) for k, _, _ in held])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _, _ in held])), pa.array(np.concatenate([k for _, k, _ in held])), pa.array(ranks)], ["key", "kind", "rank"])


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


def half_hashes(line: str) -> tuple[int, int, int, int]:
    """Hashes of both halves, of the line itself and as the longer one of two lines."""
    n, m = len(line), len(line) - 1
    a, b = n // 2, m // 2
    return _hash(line[:a], 2 * n), _hash(line[a:], 2 * n + 1), _hash(line[:b], 2 * m), _hash(line[b + 1 :], 2 * m + 1)


def has_word(line: str) -> bool:
    return bool(line.strip(SPACES))


def _occurrences(least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["_d", "_t", "no", "h1", "h2", "k1", "k2", "k3", "k4"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each different line with a word of each text, at its first place there."""
        for batch in batches:
            of: list[int] = []
            rows: list[tuple] = []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                seen: set[str] = set()
                for no, line in enumerate(text.split("\n")):
                    if line not in seen and has_word(line):
                        seen.add(line)
                        halves = half_hashes(line) if len(line) >= least_chars else (None,) * 4
                        rows.append((no, _hash(line), _hash(line, 1), *halves))
                        of.append(i)
                if len(rows) >= EMIT_ROWS:
                    yield made(batch, of, rows)
                    of, rows = [], []
            if rows:
                yield made(batch, of, rows)

    def made(batch: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array(of, pa.int64())
        columns = [pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))]
        return pa.RecordBatch.from_arrays([batch.column("_d").take(at), batch.column("_t").take(at), *columns], names)

    return run


def within_one(a: str, b: str) -> bool:
    """Whether one character inserted, deleted or replaced makes the lines equal (or they are); linear in their length."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)  # how far they agree, by halving
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


@F.pandas_udf(T.BooleanType())
def _within_one(line: pd.Series, earlier: pd.Series) -> pd.Series:
    return pd.Series([within_one(a, b) for a, b in zip(line, earlier, strict=True)], dtype=bool)


@F.pandas_udf(T.StructType().add("text", "string").add("n_lines", "long").add("n_dropped", "long"))
def _without(text: pd.Series, places: pd.Series) -> pd.DataFrame:
    """Texts without the lines at the given places, equal lines anywhere in the text, and later copies of kept lines."""
    out = []
    for t, marks in zip(text, places, strict=True):
        if t is None:
            out.append((None, 0, 0))
            continue
        lines = t.split("\n")
        words = [has_word(x) for x in lines]
        gone = {lines[m] for m in marks} if marks is not None else set()
        seen: set[str] = set()
        left = []
        for line, word in zip(lines, words, strict=True):
            if word:
                if line in gone or line in seen:
                    continue
                seen.add(line)
            left.append(line)
        out.append(("\n".join(left), sum(words), len(lines) - len(left)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 1) -> DataFrame:
    """``df`` with the text's later lines taken out, and ``n_lines``, ``n_dropped`` (lines with a word; long)."""
    require(df, [key, text])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(key).alias("_d"), F.xxhash64(F.col(text)).alias("_t"), F.col(text).alias("_text"))
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField("_d", kind), *(T.StructField(c, T.IntegerType() if c == "no" else T.LongType()) for c in ("_t", "no", "h1", "h2", "k1", "k2", "k3", "k4"))])
    found = docs.where("_text is not null").mapInArrow(_occurrences(least_chars - 1), out)
    # what orders occurrences by document (none first) and line, one number if it can be; texts of one doc_id are told apart below
    if isinstance(kind, T.IntegralType):
        number = F.coalesce(F.col("_d").cast("decimal(20,0)"), F.lit(str(-(10**19))).cast("decimal(20,0)"))
        place = (number * F.lit(1 << 31).cast("decimal(10,0)") + F.col("no")).cast("decimal(38,0)")
    else:
        place = F.struct(F.col("_d").isNotNull().alias("known"), "_d", "no")
    lines = written(found.withColumn("at", place), "line-places")
    halves = [f"k{i}" for i in range(1, 5)]
    distinct = lines.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n"), *(F.max(k).alias(k) for k in halves))
    distinct = written(distinct, "lines")

    each = distinct.where("k1 is not null").select("h1", "h2", F.explode(F.array(*halves)).alias("half"))
    shared = written(each.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), "halves")
    near = written(join_counted(each, shared, ["half"], "left_semi", shared.count()).select("h1", "h2").distinct(), "near-lines")
    n_near = near.count()
    places = join_counted(lines.select("h1", "h2", "_d", "_t", "no", "at"), near, ["h1", "h2"], "left_semi", n_near)
    firsts = join_counted(distinct.select("h1", "h2", "first"), near, ["h1", "h2"], "left_semi", n_near)
    places = written(join_counted(places, written(firsts, "near-firsts"), ["h1", "h2"], "inner", n_near).where("at = first").groupBy("h1", "h2", "first", "_d", "no").agg(F.min("_t").alias("_t")), "near-places")
    of_doc = F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_t") == F.col("_t2"))
    renamed = places.select(F.col("_d").alias("_d2"), F.col("_t").alias("_t2"), "no", "h1", "h2", "first")
    if n_near <= SMALL_ROWS:
        renamed = F.broadcast(renamed)
    texts = docs.join(renamed, of_doc).select("h1", "h2", "first", "_t2", F.get(F.split("_text", "\n"), F.col("no")).alias("line"))
    # numbers that follow the order of the corpus: sorted ranges, then the place in them
    texts = texts.dropDuplicates(["h1", "h2"]).orderBy("first", "_t2", "h1", "h2").withColumn("rank", F.monotonically_increasing_id())
    texts = written(texts, "near-texts")

    variants = written(texts.select("rank", "line", "h1").repartition(parts, "h1").drop("h1").mapInArrow(_emit, "key long, kind byte, rank long"), "line-variants")
    kept, cut = (F.min(F.when(F.col("kind") == DELETED, F.col("rank")) if k else F.when(F.col("kind") != DELETED, F.col("rank"))) for k in (0, 1))
    groups = written(variants.groupBy("key").agg(F.count("*").alias("n"), kept.alias("kept"), cut.alias("cut")).where("n > 1").select("key", "kept", "cut"), "variant-groups")
    members = join_counted(variants, groups, ["key"], "inner", groups.count())
    partner = F.when(F.col("kind") == WHOLE, F.col("cut")).otherwise(F.col("kept"))
    pairs = written(members.withColumn("p", partner).where("p < rank").select("rank", "p").distinct(), "line-pairs")
    mine = pairs.join(texts.select("rank", "line"), "rank")
    both = mine.join(texts.select(F.col("rank").alias("p"), F.col("line").alias("earlier")), "p")
    gone = both.where(F.greatest(F.length("line"), F.length("earlier")) >= least_chars).where(_within_one("line", "earlier")).select("rank").distinct()
    gone = written(gone.join(texts.select("rank", "h1", "h2"), "rank").select("h1", "h2", F.lit(True).alias("near")), "near-gone")

    repeated = join_counted(distinct.select("h1", "h2", "first", "n"), gone, ["h1", "h2"], "left", gone.count()).where("n > 1 or near")
    repeated = written(repeated.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "repeated-lines")
    at = join_counted(lines.select("_d", "_t", "no", "h1", "h2", "at"), repeated, ["h1", "h2"], "inner", repeated.count())
    # an equal line at the same place of several texts of one doc_id stays in the first of these texts
    tied = at.where("not near and at = first").groupBy("h1", "h2").agg(F.min("_t").alias("t0"), F.max("_t").alias("t1")).where("t0 <> t1")
    tied = written(tied.select("h1", "h2", "t0"), "tied-lines")
    n_tied = tied.count()
    if n_tied:
        at = join_counted(at, tied, ["h1", "h2"], "left", n_tied)
    drops = at.where("near or at <> first" + (" or _t <> t0" if n_tied else "")).groupBy(F.col("_d").alias("_d2"), F.col("_t").alias("_t2")).agg(F.collect_set("no").alias("_drops"))
    drops = written(drops, "dropped-lines")

    mine = others(df, "n_lines", "n_dropped")
    d, t, d2, t2, gone, w = fresh(mine, "_d", "_t", "_d2", "_t2", "_drops", "_w")
    drops = drops.toDF(d2, t2, gone)
    marked = df.select(*mine, F.col(key).alias(d), F.xxhash64(F.col(text)).alias(t)).join(drops, F.col(d).eqNullSafe(F.col(d2)) & (F.col(t) == F.col(t2)), "left")
    done = marked.withColumn(w, _without(F.col(text), F.col(gone)))
    return done.select(*(F.col(f"{w}.text").alias(text) if c == text else F.col(c) for c in mine), f"{w}.n_lines", f"{w}.n_dropped")

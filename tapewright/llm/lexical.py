"""Ranked lexical search over a bit-sliced impact index.

A document's impact for a term is a whole number (its part of a score). The index cuts documents into blocks of at most
``BLOCK_DOCS`` and holds, for each block and term, the term's documents and one bitmap for each bit of their impacts.
A query's scores in a block are made for all its documents at once: the bitmaps of its terms are added slice by slice
with carries (sum ``a ^ b ^ c``, carry the majority), for a group of queries side by side. The best k are found from the most
significant slice down: documents with the bit are taken if they are k or fewer, else the search goes on among them.
The best k of every block then meet.

How it is distributed: a block is made by the task that reads its documents, in three passes: term counts by block, sums of them
over the corpus, impacts and their slices. Searching joins the index to the queries' terms and takes a block and a group of
queries a task; nothing else is sent, and neither side is ever multiplied but by groups of queries.

Defined results: null and empty texts have no terms; texts of any length are counted whole; repeated rows are documents
of their own, and equal scores go by ascending id, null ids last; a query without terms or without a document above 0
has no rows; repeated queries are queries of their own; empty tables give an empty result; columns of the queries named like
results are replaced, others pass through whatever their names.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import SMALL_ROWS, join_counted, others, require, tidy, written

BLOCK_DOCS = 8192
GROUP_QUERIES = 256
RESULTS = ("rank", "doc_id", "score")
#: Separators become spaces and A-Z lower case; bytes of 0x80 and up belong to terms.
FOLD = bytes(b if b >= 0x80 or chr(b) in string.ascii_lowercase + string.digits else ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else 0x20 for b in range(256))
ONE = np.uint64(1)


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


@dataclass(frozen=True)
class Index:
    """``slices``: block, term, the ordinals of its documents and their impacts' bitmaps; ``docs``: block, ord, id."""

    slices: DataFrame
    docs: DataFrame


# --- counting


def counted(batches: Iterator[pa.RecordBatch], keep: frozenset[bytes] | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents of a task: a row for each document that has a kept term, for each term, and one of totals."""
    block = TaskContext.get().partitionId() << 32
    ids: list = []
    sizes: list[int] = []
    held: dict[bytes, tuple[list[int], list[int]]] = {}
    n_docs = total = 0

    def flush() -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        cols: dict[str, list] = {name: [] for name in schema.names}

        def put(**row) -> None:
            for name, col in cols.items():
                col.append(row.get(name))

        put(block=block, n=n_docs, total=total)
        for at, i in enumerate(order):
            put(block=block, ord=at, doc=ids[i], n=sizes[i])
        for term, (docs, counts) in held.items():
            at = place[docs]
            by = np.argsort(at)
            put(block=block, n=len(docs), term=term.decode("utf-8", "replace"), ords=at[by].astype("<u2").tobytes(), tfs=np.array(counts)[by].astype("<u4").tobytes())
        return pa.RecordBatch.from_pydict(cols, schema)

    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not raw or not (terms := terms_of(raw)):
                continue
            n_docs, total = n_docs + 1, total + len(terms)
            counts = Counter(terms)
            found = counts.keys() if keep is None else counts.keys() & keep
            if not found:
                continue
            at = len(ids)
            ids.append(doc)
            sizes.append(len(terms))
            for t in found:
                if (lists := held.get(t)) is None:
                    lists = held[t] = ([], [])
                lists[0].append(at)
                lists[1].append(counts[t])
            if len(ids) == BLOCK_DOCS:
                yield flush()
                block, ids, sizes, held, n_docs, total = block + 1, [], [], {}, 0, 0
    if n_docs:
        yield flush()


def sliced(values: np.ndarray) -> tuple[int, bytes]:
    """How many bits the values need, and a bitmap over the values for each bit, the least first."""
    n = int(values.max()).bit_length() if len(values) else 0
    bits = (values[None, :] >> np.arange(n)[:, None]) & 1
    return n, np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").tobytes()


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> Index:
    """The index of ``docs``; with ``terms`` (a column ``term``) only theirs, by which no score of such terms changes.

    The terms are sent to the tasks if they are at most ``SMALL_ROWS``, counted before, and joined otherwise.
    """
    require(docs, [doc_id, text])
    spark = docs.sparkSession
    keep = None
    if terms is not None and terms.count() <= SMALL_ROWS:
        keep = spark.sparkContext.broadcast(frozenset(r["term"].encode() for r in terms.collect()))
    kind = docs.schema[doc_id].dataType
    out = T.StructType([T.StructField(n, t) for n, t in (("block", T.LongType()), ("ord", T.IntegerType()), ("doc", kind), ("n", T.LongType()), ("total", T.LongType()), ("term", T.StringType()), ("ords", T.BinaryType()), ("tfs", T.BinaryType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        names = {"block": pa.int64(), "ord": pa.int32(), "doc": first.schema.field(0).type, "n": pa.int64(), "total": pa.int64(), "term": pa.string(), "ords": pa.binary(), "tfs": pa.binary()}

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        yield from counted(again(), keep.value if keep is not None else None, pa.schema(list(names.items())))

    raw = written(docs.select(F.col(doc_id).alias("doc"), F.encode(F.col(text), "UTF-8").alias("raw")).mapInArrow(count, out), "term-counts")
    sums = raw.where("total is not null").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n_docs, n_terms = int(sums["n"] or 0), int(sums["total"] or 1)
    postings = raw.where("term is not null").select("block", "term", "n", "ords", "tfs")
    if terms is not None and keep is None:
        postings = postings.join(terms.select("term"), "term", "left_semi")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = written(postings.groupBy("term").agg(F.sum("n").alias("df")).select("term", weight.alias("w")), "term-weights")
    feed = join_counted(postings, weights, ["term"], "inner", weights.count()).select("block", "term", "ords", "tfs", "w", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("long").alias("n"))
    members = raw.where("ord is not null")
    feed = feed.unionByName(members.select("block", "ord", "n"), allowMissingColumns=True)

    def slices(frame: pd.DataFrame) -> pd.DataFrame:
        """Impacts of a block's terms in bitmaps; the frame is bounded by the documents of a block."""
        own = frame["ord"].notna()
        length = np.zeros(BLOCK_DOCS, np.int64)
        length[frame.loc[own, "ord"].astype(int)] = frame.loc[own, "n"].astype("int64")
        m = 100 - 75 + (75 * length * n_docs) // n_terms
        rows = []
        for b, term, ords, tfs, w in frame.loc[~own, ["block", "term", "ords", "tfs", "w"]].itertuples(index=False):
            at, tf = np.frombuffer(ords, "<u2"), np.frombuffer(tfs, "<u4").astype(np.int64)
            n, bits = sliced(int(w) * (10**9 * tf // (1000 * tf + 8 * m[at])))
            if n:
                rows.append((b, term, ords, n, bits))
        return pd.DataFrame(rows, columns=["block", "term", "ords", "n_slices", "bits"])

    made = written(feed.groupBy("block").applyInPandas(slices, "block long, term string, ords binary, n_slices int, bits binary"), "slices")
    return Index(made, members.select("block", "ord", "doc"))


# --- searching


def spread(ords: bytes, n_slices: int, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words of 64 documents that a term occurs in, and its slices in them."""
    at = np.frombuffer(ords, "<u2")
    packed = np.frombuffer(bits, np.uint8).reshape(n_slices, -1)
    values = np.unpackbits(packed, axis=1, count=len(at), bitorder="little").astype(np.uint64) << (at & 63).astype(np.uint64)
    words, first = np.unique(at >> 6, return_index=True)
    return words.astype(np.int64), np.add.reduceat(values, first, axis=1)


def add(total: np.ndarray, more: np.ndarray) -> None:
    """Add slices to slices (each [slice, query, word]), all documents of all queries at once."""
    carry = np.zeros(total.shape[1:], np.uint64)
    for b in range(len(total)):
        a = total[b]
        if b < len(more):
            x = a ^ more[b]
            nxt = (a & more[b]) | (x & carry)
        else:
            x, nxt = a, a & carry
        total[b] = x ^ carry
        carry = nxt


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps [query, word] of the documents sure to be among the best k, and of those that share the last places."""
    among = np.bitwise_or.reduce(total, axis=0)
    sure = np.zeros_like(among)
    for b in range(len(total) - 1, -1, -1):
        with_bit = among & total[b]
        n = np.bitwise_count(sure | with_bit).sum(axis=1, dtype=np.int64)
        many = (n > k)[:, None]
        sure = np.where(many, sure, sure | with_bit)
        among = np.where(many, with_bit, among & ~total[b])
    return sure, among


def places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(frame: pd.DataFrame, k: int) -> list[tuple[int, int, int]]:
    """Query, ordinal and score of the best k of a block for each query; the frame has the terms' slices and their uses."""
    entries: dict[int, list[tuple[int, int]]] = {}
    terms = []
    for ords, n, bits, uses in frame[["ords", "n_slices", "bits", "uses"]].itertuples(index=False):
        for use in uses:
            for shift in (s for s in range(int(use["times"]).bit_length()) if use["times"] >> s & 1):
                entries.setdefault(int(use["query"]), []).append((len(terms), shift))
        terms.append(spread(ords, n, bits))
    if not entries:
        return []
    queries = sorted(entries)
    width = 1 + max(int(w[-1]) for w, _ in terms)
    high = max(sum((1 << (len(terms[t][1]) + s)) - 1 for t, s in used) for used in entries.values()).bit_length()
    total = np.zeros((high, len(queries), width), np.uint64)
    for turn in range(max(map(len, entries.values()))):
        now = [(i, *entries[q][turn]) for i, q in enumerate(queries) if turn < len(entries[q])]
        more = np.zeros((max(len(terms[t][1]) + s for _, t, s in now), len(queries), width), np.uint64)
        for i, t, s in now:
            words, slices = terms[t]
            more[s : s + len(slices), i, words] = slices
        add(total, more)
    sure, tied = best(total, k)
    out = []
    for i, q in enumerate(queries):
        chosen = places(sure[i])
        chosen = np.concatenate([chosen, places(tied[i])[: k - len(chosen)]])
        words, bit = chosen >> 6, (chosen & 63).astype(np.uint64)
        scores = [0] * len(chosen)
        for b in range(high):
            for j, x in enumerate(((total[b, i, words] >> bit) & ONE).tolist()):
                scores[j] |= x << b
        out += [(q, int(o), s) for o, s in zip(chosen, scores, strict=True) if s]
    return out


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """query, term, times for each different term of each query (``query`` and ``text`` in ``queries``)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(q, t.decode("utf-8", "replace"), n) for q, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t, n in Counter(terms_of(raw or b"")).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["query", "term", "times"])

    return queries.select("query", F.encode(F.col(text), "UTF-8").alias("raw")).mapInArrow(split, "query long, term string, times long")


def search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_text: str = "text", k: int = 10) -> DataFrame:
    """The k best documents of each query: the query's columns with rank (int, from 1), doc_id and score (long)."""
    require(queries, [query_text])
    with tidy(docs.sparkSession):
        given = F.struct(*others(queries, *RESULTS)).alias("given")
        asked = written(queries.select(F.monotonically_increasing_id().alias("query"), given, F.col(query_text).alias("text")), "queries", keep=True)
        used = written(query_terms(asked, "text"), "query-terms")
        index = build(docs, doc_id, text, used.select("term").distinct())
        return _ranked(index, asked, used, k)


def _ranked(index: Index, asked: DataFrame, used: DataFrame, k: int) -> DataFrame:
    n_groups = -(-max(1, asked.count()) // GROUP_QUERIES)
    group = F.pmod(F.xxhash64("query"), F.lit(n_groups)).cast("int")
    uses = written(used.groupBy("term", group.alias("group")).agg(F.collect_list(F.struct("query", "times")).alias("uses")), "term-uses")
    feed = join_counted(index.slices, uses, ["term"], "inner", uses.count())

    def of_block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = search_block(frame, k)
        return pd.DataFrame([(q, key[0], o, s) for q, o, s in found], columns=["query", "block", "ord", "score"])

    local = written(feed.groupBy("block", "group").applyInPandas(of_block, "query long, block long, ord int, score long"), "block-best")
    named = join_counted(index.docs, local, ["block", "ord"], "inner", local.count()).select("query", "score", F.col("doc").alias("doc_id"))
    first = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = written(named.select("*", F.row_number().over(first).alias("rank")).where(F.col("rank") <= k), "ranked", keep=True)
    return asked.select("query", "given").join(ranked, "query").select("given.*", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

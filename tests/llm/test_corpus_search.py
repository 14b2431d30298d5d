"""Decontamination, ranked search and the prefix trie against brute force, on small tables with the awkward cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import lexical, prefix_trie, queries, winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ("row", "given", "text", "words", "prints", "hits", "span", "query", "block", "ord", "term", "rank", "score", "item", "key", "window", "n_words", "at")


def low(text):
    return re.sub("[A-Z]", lambda c: c[0].lower(), text or "")


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Documents and items: shared passages, items of every length, repeated items, odd characters, ties."""
    rng = random.Random(12)
    items = [(i, sentence(rng, n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 25, 60])]
    items += [(20, "É ß É\u0085x ÉCOLE Ünder 9 lives of a cat and more"), (20, sentence(rng, 12)), (21, None), (22, ""), (23, "...!"), (None, sentence(rng, 14)), (24, items[11][1]), (25, "same same same same same same same same same same same")]
    docs = [(i, sentence(rng, rng.randint(0, 60))) for i in range(40)]
    for k, (_, text) in enumerate(items):
        w = (text or "").split()
        docs.append((100 + k, f"{sentence(rng, 7)}, {'-'.join(w).upper()}! {sentence(rng, 5)}"))
        if len(w) > 10:
            cut = rng.randrange(len(w) - 10)
            docs.append((200 + k, " ".join(["zz", *w[cut : cut + 10], "zz", *w[:9], "zz", *w[cut : cut + 9]])))
            docs.append((300 + k, " ".join([*w[: len(w) // 2], "q", *w[len(w) // 2 :]])))
    docs += [(100, docs[40][1]), (7, docs[7][1]), (None, docs[42][1]), (None, None), (5, None), (6, ""), (8, " \n\t"), (9, "same " * 30), (10, " ".join(t or "" for _, t in items) * 3), (11, sentence(rng, 20_000))]
    return docs, items


def frames(spark, corpus, clash=False):
    docs = spark.createDataFrame(corpus[0], "doc_id long, body string").repartition(5)
    items = spark.createDataFrame(corpus[1], "item_id long, body string")
    return (df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES))) if clash else df for df in (docs, items))


# --- 11


def plain_hits(docs, items):
    windows = defaultdict(set)
    for i, text in items:
        w = WORD.findall(low(text))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = WORD.findall(low(text))
        hit, held = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    held |= found
        out.append((d, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_every_shared_span_is_found(spark, corpus):
    docs, items = frames(spark, corpus)
    out = winnowing.decontaminate(docs, items, "body", "item_id", "body")
    rows = out.collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows), key=str) == plain_hits(*corpus)
    for r in rows:  # places and lengths cover just the words that are hit
        assert len({p for h in r["hits"] for p in range(h["at"], h["at"] + h["span"])}) == r["n_hit"]


def test_decontamination_of_awkward_tables(spark, corpus):
    docs, items = frames(spark, corpus, clash=True)
    out = winnowing.decontaminate(docs, items, "body", "item_id", "body")
    assert {c: n for c, n in Counter(out.columns).items() if n > 1} == {} and out.where("row <> 0 or given <> 1").isEmpty() and out.count() == len(corpus[0])
    none = winnowing.decontaminate(docs, items.where("false"), "body", "item_id", "body")
    assert none.count() == len(corpus[0]) and none.where("contaminated or n_hit > 0 or n_items > 0").isEmpty()
    assert winnowing.decontaminate(docs.where("false"), items, "body", "item_id", "body").isEmpty()


def test_fingerprints_of_a_shared_span_agree(spark):
    rng = random.Random(3)
    shared = sentence(rng, 10)
    rows = [(f"{sentence(rng, rng.randint(0, 9))} {shared} {sentence(rng, rng.randint(0, 9))}".strip(),) for _ in range(50)]
    words = spark.createDataFrame(rows, "t string").select(winnowing.words_of(F.col("t")).alias("words"))
    made = winnowing.with_grams(words, "words", [10], 5).select(winnowing.fingerprints([10], 5).alias("f")).collect()
    sets = [set(r["f"]) for r in made]
    assert all(a & b for a in sets for b in sets)


# --- 12


def plain_ranking(docs, items, k=10):
    texts = [(d, Counter(TERM.findall(low(t)))) for d, t in docs]
    texts = [(d, c, sum(c.values())) for d, c in texts if c]
    n_docs, total = len(texts), sum(n for *_, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        wanted = Counter(TERM.findall(low(text)))
        for d, c, n in texts:
            m = 100 - 75 + 75 * n * n_docs // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [True, False])
def test_ranking_is_that_of_all_scores(spark, corpus, monkeypatch, few):
    if few:  # blocks of a few documents, groups of a few queries, terms met by a join
        monkeypatch.setattr(lexical, "GROUP_QUERIES", 4)
        monkeypatch.setattr(lexical, "SMALL_ROWS", 5)
    docs, items = frames(spark, corpus)
    got = lexical.search(docs, items, "doc_id", "body", "body").select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(*corpus)


def test_blocks_are_cut_at_their_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "BLOCK_DOCS", 4)
    monkeypatch.setattr(lexical.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 2})()))
    schema = pa.schema([("block", pa.int64()), ("ord", pa.int32()), ("doc", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("term", pa.string()), ("ords", pa.binary()), ("tfs", pa.binary())])
    batch = pa.RecordBatch.from_pydict({"doc": [9, 3, None, 5, 4, 1], "raw": [b"a b", b"B a a", b"b", b"!", b"c", b"b b"]})
    rows = [r for b in lexical.counted(iter([batch]), frozenset([b"b", b"a", b"c"]), schema) for r in b.to_pylist()]
    assert sorted({r["block"] for r in rows}) == [2 << 32, (2 << 32) + 1]
    assert [(r["ord"], r["doc"], r["n"]) for r in rows if r["ord"] is not None] == [(0, 3, 3), (1, 4, 1), (2, 9, 2), (3, None, 1), (0, 1, 2)]
    b = next(r for r in rows if r["term"] == "b")
    assert np.frombuffer(b["ords"], "<u2").tolist() == [0, 2, 3] and np.frombuffer(b["tfs"], "<u4").tolist() == [1, 1, 1]
    assert [(r["n"], r["total"]) for r in rows if r["total"] is not None] == [(4, 7), (1, 2)]


def test_bit_slices_add_and_rank_like_numbers():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 20, (6, 3, 128)) * (rng.random((6, 3, 128)) < 0.6)
    values[1, :, :40] = values[0, :, :40]
    as_slices = lambda v: np.stack([np.stack([np.packbits(((row >> b) & 1).astype(np.uint8), bitorder="little").view(np.uint64) for row in v]) for b in range(20)])
    total = np.zeros((24, 3, 2), np.uint64)
    for v in values:
        lexical.add(total, as_slices(v))
    want = values.sum(0)
    got = sum(np.stack([np.unpackbits(t.view(np.uint8), bitorder="little") for t in total[b]]).astype(np.int64) << b for b in range(24))
    assert (got == want).all()
    sure, tied = lexical.best(total, 10)
    for q in range(3):
        chosen = lexical.places(sure[q]).tolist()
        chosen += lexical.places(tied[q])[: 10 - len(chosen)].tolist()
        order = sorted(range(128), key=lambda i: (-want[q, i], i))[:10]
        assert sorted(chosen) == sorted(order)


def test_search_of_awkward_tables(spark, corpus):
    docs, items = frames(spark, corpus, clash=True)
    out = lexical.search(docs, items, "doc_id", "body", "body")
    assert {c: n for c, n in Counter(out.columns).items() if n > 1} == {} and out.where("row <> 0 or given <> 1").isEmpty() and not out.isEmpty()
    assert lexical.search(docs.where("false"), items, "doc_id", "body", "body").isEmpty()
    assert lexical.search(docs, items.where("false"), "doc_id", "body", "body").isEmpty()
    names = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "body")
    got = lexical.search(names, items, "doc_id", "body", "body", k=3).collect()
    assert all(r["doc_id"] is None or r["doc_id"].startswith("d") for r in got) and max(r["rank"] for r in got) == 3


# --- 13


def plain_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        by[c].append(((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    turns = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in by.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        base = None if c is None else c - int(math.fmod(c, 20))
        paths[c] = turns.get(base, [])[:h] + own[h:] if c is not None else own
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    least = lambda m: min((c for c in m if c is not None), default=None)
    children = Counter(n[:-1] for n in members if n)
    out = []
    for node, m in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in m if c is not None and len(paths[c]) == len(node))
        out.append((least(m), len(node), least(members[node[:-1]]) if node else None, len(m), children[node], sum(not children[n] for n in below), sum((len(members[n]) - 1) * len(SPACED.findall(n[-1][1])) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("parts", ["1", "5"])
def test_nodes_are_those_of_a_plain_trie(spark, tmp_path, parts):
    rng = random.Random(2)
    said = ["hello there", "a b  c", "", None, "x y z"]
    rows = [(c, t, rng.choice(["user", "user", None]), rng.choice(said)) for c in [*range(0, 70, 1), -3, -21, -20, 1007] if c % 7 != 3 for t in range(rng.choice([1, 1, 2, 4, 9]))]
    rows += [(40, t, "user", "the same") for t in range(60)] + [(c, t, "user", "the same") for c in (41, 42, 43) for t in range(61)]
    rows += [(80, None, "user", "first"), (80, 2, "user", "third"), (80, 2, "user", "third"), (80, 2, None, "second"), (None, 0, "user", "lost"), (None, 1, None, None), (81, 0, "12:user", "x"), (82, 0, "12", "user:x")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_prefix_trie(spark, str(tmp_path)).select(*COLUMNS).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)


def test_trie_of_awkward_tables(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    monkeypatch.setattr(prefix_trie, "FAN_IN", 2)
    turns = spark.createDataFrame([(c, 0, "user", "hi") for c in range(9)], "conv_id long, turn long, role string, text string").select("*", *(F.lit(1).alias(c) for c in ("trie", "key", "depth", "digest", "_block"))).repartition(7)
    numbered = prefix_trie.numbered_turns(turns)
    got = prefix_trie.trie(numbered.withColumnRenamed("position", "depth"), numbered.select("conv_id").distinct()).select(*COLUMNS).collect()
    ids = hashlib.sha256(b"0,1,2,3,4,5,6,7,8").hexdigest()
    assert sorted(map(tuple, got)) == [(0, 0, None, 9, 1, 1, 8, hashlib.sha256(b"").hexdigest()), (0, 1, 0, 9, 0, 1, 8, ids)]
    none = prefix_trie.numbered_turns(turns.where("false"))
    assert prefix_trie.trie(*prefix_trie.rebuilt(none)).isEmpty()

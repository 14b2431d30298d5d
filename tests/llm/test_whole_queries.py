"""The registered queries that have no SQL, each over awkward tables, against brute force."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from test_operators import changed, least_cost, plain_line_dedup, plain_rule, plain_similarity, plain_statistics, sentence

from tapewright.llm import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, labels, pages and conversations with nulls, repeats, empty and long texts, ties and extra columns."""
    rng = random.Random(31)
    good = [sentence(rng, rng.randint(20, 70)) for _ in range(50)]
    loud = [" ".join(w + "!!" for w in sentence(rng, 30).upper().split()) for _ in range(30)]
    texts = [*good, *loud, *(changed(rng, g, 1) for g in good[:6]), good[3], good[3], good[8] + "\n" + good[9], "", " \n\t ", "one", "a b c d e " * 6, "y" * 3000, sentence(rng, 5000), "É ü 你好 🙂\u0085 z it's  12 ３"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, good[1], "en", None, 1), (5, texts[5], None, "s", None), (5, "other text of five", "en", "s", 0), (900, None, "en", "s", 0), (None, None, None, None, None)]
    labels = [(i, int(i < 50), 0) for i in range(80) if i % 2] + [(None, 0, 0), (3, None, 1), (7, 1, 0)]
    pages = [(i, u, "x") for i, u in enumerate(["http://A.Example.com/en/7x?q", "https://x.net/de/8", "https://example.net/de/81#a", "http://com/en/", "notcom/en/", None, "", "ftp://h.org/es/a://b/en/", "http://q?x=://y", "http://q?x=://y", "http://long/" + "s/" * 2000])]
    turns = [(c, t, rng.choice(["system", "user", "assistant", " User", None, "tool"]), rng.choice(["hi", "", None, "a\nb"])) for c in range(25) for t in range(rng.randint(1, 8))] + [(None, 0, "assistant", "x"), (None, None, "user", "y"), (31, 0, "user", "q"), (31, 0, "user", "q")]
    path = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("pages", pages, "page_id long, url string, html string"),
        ("conversations", turns, "conv_id long, turn long, role string, text string"),
    ):
        spark.createDataFrame(rows, schema).withColumnsRenamed({}).selectExpr("*", "1 AS key", "2 AS given").repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path, docs, labels, pages, turns


def test_op1_statistics_and_verdicts(spark, tables):
    path, docs, *_ = tables
    got = queries.op1_quality_rules(spark, path).collect()
    want = Counter()
    for d, t, *_ in docs:
        n, chars, symbols, dup, repeat = plain_statistics(t)
        failed = n < 10 or 100 * repeat > 20 * n
        want[d, n, chars, symbols, dup, repeat, failed, not failed and "!!" not in (t or "")] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got) == want


def test_op3_hosts_paths_and_rules(spark, tables):
    path, _, _, pages, _ = tables
    got = {r["page_id"]: r for r in queries.op3_url_rules(spark, path).collect()}
    assert len(got) == len(pages)
    for i, url, _ in pages:
        host, p, rule, said = plain_rule(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, p, rule)
        assert got[i]["verdict"] == (said or ("block" if got[i]["mined"] else "allow"))


def test_op4_pieces_and_places(spark, tables):
    from tokenizers import Tokenizer

    path, docs, *_ = tables
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t, *_ in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[d, k // 2048, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    rows = queries.op4_packing(spark, path).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(held)) and sum(held[-1]) <= 2048
    assert len(bins) == -(-sum(n for *_, n, _ in want.elements()) // 2048)


def test_op5_classes(spark, tables):
    path, docs, *_ = tables
    kinds = sorted({t or "" for _, t, *_ in docs})
    root = {t: t for t in kinds}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for x, y in itertools.combinations(kinds, 2):
        if plain_similarity(x, y) >= 0.8:
            root[find(x)] = find(y)
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            k = find(t or "")
            least[k] = min(least.get(k, d), d)
    want = Counter((d, t or "") for d, t, *_ in docs)
    got = queries.op5_order_minhash(spark, path).collect()
    assert Counter((r["doc_id"], r["class_id"], r["copies"]) for r in got) == Counter((d, least.get(find(t)), n) for (d, t), n in want.items())


def test_op6_costs_and_chunks(spark, tables):
    path, *_, turns = tables
    rows = queries.op6_chat(spark, path).collect()
    assert len(rows) == len(turns)
    code = lambda r: {"system": 1, "user": 2, "assistant": 3}.get((r or "").strip().lower(), 0)
    by = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r[:2]) + tuple((x is not None, x or "") for x in r[2:])):
        by[c].append((t, role, text))
    for r in rows:
        assert r["conversation_cost"] == least_cost([code(x[1]) for x in by[r["conv_id"]]])
    for c, given in by.items():  # what each turn became makes its chunk
        own = [r for r in rows if r["conv_id"] == c]
        chunks = {(r["turn"], r["chunk_crc32"]) for r in own}
        assert len(own) == len(given) and all(r["out_role"] in ("system", "user", "assistant") for r in own) and chunks


def test_op7_kept_lines(spark, tables):
    path, docs, *_ = tables
    want = plain_line_dedup([(d, t) for d, t, *_ in docs])
    got = queries.op7_line_dedup(spark, path).collect()
    assert Counter((r["doc_id"], r["kept_crc32"]) for r in got) == Counter((d, zlib.crc32((want[d, t] or "").encode())) for d, t, *_ in docs)


def test_op8_ids_and_bytes(spark, tables):
    import tiktoken

    path, docs, *_ = tables
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t, *_ in docs:
        ids = enc.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = queries.op8_byte_bpe(spark, path).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want

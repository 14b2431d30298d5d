"""The corpus pipeline against plain versions of its stages, on a small corpus with the awkward cases."""

from __future__ import annotations

import itertools
import random
import struct
import zlib

import corpus_pipeline
import public_tokenizers
from test_operators import changed, plain_line_dedup, plain_similarity, plain_statistics, sentence

from tapewright.llm import quality_rules


def test_pipeline_matches_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(21)
    base = [sentence(rng, 80) for _ in range(8)]
    shared = sentence(rng, 12)
    texts = [*base, *(changed(rng, b, 1) for b in base[:4]), base[0], base[5] + "\n" + shared, base[6] + "\n" + shared + "\n" + shared[:-1] + "Q", "too short", None, "", "spam ham " * 60, sentence(rng, 3000)]
    loud = [" ".join(w + "!!" for w in sentence(rng, 40).upper().split()) for _ in range(60)]  # what the labels call bad
    calm = [sentence(rng, 40) for _ in range(60)]
    texts += loud + calm
    labels = [(i, int(t in calm), 0) for i, t in enumerate(texts) if t in loud[::2] or t in calm[::2]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS key", "2 AS text", "3 AS n_words").write.parquet(f"{tmp_path}/labels.parquet")

    left = []
    for i, t in enumerate(texts):
        n, _, _, _, repeat = plain_statistics(t)
        if n >= 10 and 100 * repeat <= 20 * n and t not in loud:
            left.append((i, t))
    lines = plain_line_dedup(left)
    left = [(i, lines[i, t]) for i, t in left]
    root = {i: i for i, _ in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in itertools.combinations(left, 2):
        if x == y or plain_similarity(x, y) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    left = [(i, t) for i, t in left if find(i) == i]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in left:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.add((i, k // 2048, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got} == want and len(got) == len(want)
    assert quality_rules.keep(docs.where("false"), spark.read.parquet(f"{tmp_path}/labels.parquet")).isEmpty()


def test_clean_documents_stay_and_bad_ones_go(spark):
    """Held-out accuracy on the smallest tables: no clean document goes but by the base rules."""
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = judged.select("quality", "base_failed", "failed_rule").collect()
    clean, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert not any(r["failed_rule"] for r in clean)
    assert sum(bool(r["failed_rule"] or r["base_failed"]) for r in bad) >= 0.9 * len(bad)

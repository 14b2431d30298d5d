"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import bpe, chat, lexical, line_dedup, media, order_minhash, packing, prefix_trie, quality_rules, ring, token_pieces, url_filter, warc, winnowing
from tapewright.llm.common import fresh_path, table, written


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hex digits are 4 digits of base 32."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    sha = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(sha, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), digits, letters)


# Fixed values of the task: (verdict, host, path start).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through an archive: one record each, equal payloads stored once, read back through the source."""
    warc.register(spark)
    html = utf8(F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.alias("payload"), base32_sha1(html).alias("digest"))
    groups = pages.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = written(groups.where("n > 1 and first_id is not null").select("digest", "first_id"), "payload-groups")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    records = pages.join(repeated, "digest", "left").select(
        urn("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(revisit, urn("first_id")).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("http_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    path = fresh_path(spark, "warc")
    records.write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    stored = F.col("record_type") == "response"
    return back.select(
        page("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(stored, base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, "url", URL_RULES, table(spark, sf_dir, "labels"), "page_id", "doc_id")
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined")


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with their place; the ids go as their checksum."""
    pieces = token_pieces.token_pieces(docs.select("doc_id", "text"), "text", public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "length")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document (doc_id and text): its class and how many rows it stands for."""
    return order_minhash.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "copies")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each given turn: what became of it and the checksum of its part of the rendered conversation."""
    turns = chat.repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return turns.select("conv_id", "turn", "role", "out_role", "action", F.array_join("inserted", "+").alias("inserted"), F.crc32(utf8(F.col("chunk"))).alias("chunk_crc32"), "conversation_cost")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.crc32(utf8(F.col("text"))).alias("kept_crc32"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, bpe.SPACED_PARTS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = coder.round_trip(docs, "text")
    return done.select("doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.with_feature(media.with_payload(media.with_media(docs, "text"), "media"), "media")
    return stored.select(
        "doc_id",
        F.octet_length(utf8(F.col("text"))).cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = utf8(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"))
    return ring.bounded_ring(docs, "doc_id", 16).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: how much of it lies in windows of benchmark items, and of which."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op12_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), items)
    return found.select("item_id", "rank", "doc_id", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each node of the trie over the rebuilt conversations."""
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.rebuilt(turns))


def base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: the statistics and the base rules, before anything learned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = quality_rules.with_statistics(docs).withColumn("base_failed", quality_rules.base_failed())
    return made.select("doc_id", *quality_rules.STATISTICS, "base_failed")


def written_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: hosts, paths and the written rule that decides."""
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select("page_id", url_filter.host_of(url).alias("host"), url_filter.path_of(url).alias("path"))
    return pages.withColumn("said", url_filter.written_rule(F.col("host"), F.col("path"), URL_RULES)).select("page_id", "host", "path", F.col("said.rule").alias("rule"), F.col("said.verdict").alias("said"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: the bytes that come back from the containers."""
    return op9_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: how many rows each shard has, and that its slots are gapless."""
    rows = op10_ring_shards(spark, sf_dir)
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_url_rules": op3_url_rules,
    "op4_packing": op4_packing,
    "op5_order_minhash": op5_order_minhash,
    "op6_chat": op6_chat,
    "op7_line_dedup": op7_line_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_media": op9_media,
    "op10_ring_shards": op10_ring_shards,
    "op11_winnowing": op11_winnowing,
    "op12_bit_sliced": op12_bit_sliced,
    "op13_prefix_trie": op13_prefix_trie,
    "base_statistics": base_statistics,
    "written_url_rules": written_url_rules,
    "media_payloads": media_payloads,
    "shard_balance": shard_balance,
}

RULE_SQL = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{0}}'".replace("{0}", f"{h}{p}|{v}") for v, h, p in sorted(URL_RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
) + " END"

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD_LIST = r"list_filter(string_split_regex(" + FOLDED + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
#: crc32 of the decimal form of ``conv_id``, bit by bit.
CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, u: xor(v >> 1, 3988292384 * (v & 1)))))"

ORACLE_SQL: dict[str, str] = {
    "op11_winnowing": f"""WITH b AS (SELECT item_id::VARCHAR AS item, {WORD_LIST} AS ws FROM benchmark),
    v AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS win, least(len(ws), 10) AS span FROM b WHERE len(ws) > 0),
    s AS (SELECT DISTINCT span FROM v), d AS (SELECT row_number() OVER () AS no, doc_id, {WORD_LIST} AS ws FROM documents),
    w AS (SELECT no, span, unnest(range(1, len(ws) - span + 2)) AS i, unnest(list_transform(range(1, len(ws) - span + 2), lambda i: array_to_string(ws[i:i + span - 1], ' '))) AS win FROM d, s),
    h AS (SELECT no, i, w.span, item FROM w JOIN v USING (win)), p AS (SELECT no, unnest(range(i, i + span)) AS pos FROM (SELECT DISTINCT no, i, span FROM h)),
    n AS (SELECT no, count(DISTINCT pos) AS n_hit FROM p GROUP BY 1), l AS (SELECT no, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY 1)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (no) LEFT JOIN l USING (no)""",
    "op12_bit_sliced": f"""WITH d AS (SELECT row_number() OVER () AS no, doc_id, {WORD_LIST} AS ws FROM documents), q AS (SELECT item_id, {WORD_LIST} AS ws FROM benchmark),
    qt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(ws) AS term FROM q) GROUP BY ALL), t AS (SELECT no, term, count(*) AS tf FROM (SELECT no, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    c AS (SELECT count(*) AS nn, sum(len(ws))::BIGINT AS ll FROM d WHERE len(ws) > 0), f AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, nn),
    m AS (SELECT no, doc_id, 100 - 75 + (75 * len(ws) * nn) // ll AS m FROM d, c), p AS (SELECT t.no, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part FROM t JOIN f USING (term) JOIN m USING (no)),
    r AS (SELECT item_id, no, doc_id, sum(times * part)::BIGINT AS score FROM qt JOIN p USING (term) GROUP BY ALL), k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
    "op13_prefix_trie": f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations),
    g AS (SELECT conv_id, count(*) AS n, list(sha256(length(role) || ':' || role || text) ORDER BY pos) AS ds, list(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) ORDER BY pos) AS ns FROM t GROUP BY 1),
    h AS (SELECT *, {CRC32} % 4 AS h FROM g), r AS (SELECT a.conv_id, coalesce(b.ds[1:a.h], []) || a.ds[a.h + 1:] AS ds, coalesce(b.ns[1:a.h], []) || a.ns[a.h + 1:] AS ns FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % 20),
    p AS (SELECT conv_id, len(ds) AS size, unnest(list_transform(range(0, len(ds) + 1), lambda d: {{'d': d, 'k': sha256(array_to_string(ds[1:d], ',')), 'up': sha256(array_to_string(ds[1:d - 1], ',')), 'n': coalesce(ns[d], 0)}})) AS x FROM r),
    m AS (SELECT conv_id, size, x.d AS d, x.d || x.k AS k, CASE WHEN x.d > 0 THEN (x.d - 1) || x.up END AS up, x.n AS n FROM p),
    v AS (SELECT k, d, min(up) AS up, min(n) AS n, min(conv_id) AS c, count(*) AS members, sha256(coalesce(string_agg(CASE WHEN size = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends FROM m GROUP BY ALL),
    u AS (SELECT up AS k, count(*) AS children FROM v WHERE up IS NOT NULL GROUP BY 1), z AS (SELECT v.*, coalesce(children, 0) AS children FROM v LEFT JOIN u USING (k)),
    s AS (SELECT m.k, sum((z.members - 1) * z.n) AS saved, sum((z.children = 0)::INT) AS leaves FROM z JOIN m ON m.conv_id = z.c AND m.d <= z.d GROUP BY 1)
    SELECT z.c AS conv_id, z.d AS depth, w.c AS parent_conv_id, z.members AS n_convs, z.children AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, z.ends AS ends_sha256 FROM z JOIN s USING (k) LEFT JOIN v w ON w.k = z.up""",
    "base_statistics": r"""WITH t AS (SELECT row_number() OVER () AS no, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
    i AS (SELECT no, ws, unnest(range(1, len(ws) - 3)) AS i FROM w), g AS (SELECT no, i, ws[i:i + 4] AS g FROM i), c AS (SELECT no, i, count(*) OVER (PARTITION BY no, g) AS n FROM g),
    p AS (SELECT no, unnest(range(i, i + 5)) AS pos FROM c WHERE n > 1), r AS (SELECT no, count(DISTINCT pos) AS n_repeat_words FROM p GROUP BY 1),
    s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (no))
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s""",
    "written_url_rules": f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages), r AS (SELECT *, {RULE_SQL} AS r FROM u)
    SELECT page_id, host, path, split_part(r, '|', 1) AS rule, split_part(r, '|', 2) AS said FROM r""",
    "media_payloads": """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents), p AS (SELECT doc_id, raw, octet_length(raw)::BIGINT AS n FROM t), q AS (SELECT doc_id, n AS n_bytes, raw || repeat('\\x00'::BLOB, greatest(64, (n + 63) // 64 * 64) - n) AS payload FROM p)
    SELECT doc_id, n_bytes, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256 FROM q""",
    "shard_balance": "WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT unnest(range(16))::INTEGER AS shard), k AS (SELECT shard, n // 16 + (shard < n % 16)::BIGINT AS k FROM s, n) SELECT shard, k AS n, k AS slots, 0::BIGINT AS first_slot, k - 1 AS last_slot FROM k WHERE k > 0",
    "op2_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, upper(sha1(payload)) AS sha FROM p),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS first_id FROM d),
    v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(sha, CAST(i * 5 + 1 AS INTEGER), 5))::BIGINT) AS fives FROM g)
    SELECT page_id, payload_bytes, array_to_string(list_transform(fives, lambda x: array_to_string(list_transform([32768, 1024, 32, 1], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x // k % 32 + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
      CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM v""",
}

"""Conversation prefix trie from mergeable partial tries.

A node is a distinct sequence of first turns. Its key is a digest of sums of hashes of (turn, depth) along the path, so
keys of all nodes on a path are running sums, made over ranges of long conversations. Each partition combines the nodes
of its own turns into a partial trie (members, least member, members that end there); partial tries are merged by
key, ``FAN_IN`` of them at a time, until one is left. End lists are kept beside it as sorted chunks, which are merged in order.

The rollup goes up the paths: the nodes that a conversation is the least member of are the last ones of its path, so
what a subtree holds is the sum of its members' totals over their own nodes, less what its least member owns above it. Totals
are attached to the turns and merged by key like the nodes, whatever the depth of the trie.

Defined results: a conversation without turns ends at the root; null ids are one conversation, which is a member but
neither least member (unless alone) nor in end lists; null roles and texts count as empty; turns of equal number go by role, then
by a digest of role and text; repeated rows are turns of their own; extra columns are not read; a table without conversations
has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import join_counted, require, written
from tapewright.operators.blocks import running_sums

FAN_IN = 32
CHUNK = 1024  # ids of an end list in one row
SUMS = ("k1", "k2", "k3", "k4")
ENDS = "key string, part int, no int, ids string"


def turn_digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def numbered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position (from 1, in order of turn number, null first), digest and n_words of every turn."""
    require(turns, [conv_id, turn, role, text])
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), turn_digest(F.col(role), F.col(text)).alias("digest"), n_words(F.col(text)).alias("n_words"))
    return running_sums(rows, ["conv_id"], ["turn", "role", "digest"], {"position": F.lit(1)}).select("conv_id", "position", "digest", "n_words")


def _key(sums: list[Column], depth: Column) -> Column:
    return F.md5(F.concat_ws("-", *(s.cast("string") for s in sums), depth.cast("string")))


def merged(partial: DataFrame, tries: int, by: list[str], sums: list[str], least: list[str]) -> DataFrame:
    """Partial tries (``trie`` numbers them) merged ``FAN_IN`` at a time until one is left."""
    aggs = [*(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in least)]
    made = partial.groupBy("trie", *by).agg(*aggs)  # combined within each partition before anything is sent
    while tries > FAN_IN:
        tries = -(-tries // FAN_IN)
        made = made.withColumn("trie", F.floor(F.col("trie") / FAN_IN).cast("int")).groupBy("trie", *by).agg(*aggs)
    return made.groupBy(*by).agg(*aggs)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and id, as chunks of ids joined by commas, numbered within the partition."""
    part, no, key, ids, out = TaskContext.get().partitionId(), 0, None, [], []

    def rows() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], ["key", "part", "no", "ids"])
            out.clear()

    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key or len(ids) == CHUNK:
                if ids:
                    out.append((key, part, no, ",".join(ids)))
                    no += 1
                key, ids = k, []
            ids.append(str(i))
        yield from rows()
    if ids:
        out.append((key, part, no, ",".join(ids)))
    yield from rows()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every key's chunks in order; chunks pass through, none is held."""
    key, state, out = None, None, []

    def rows() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), pa.array([r[1] for r in out])], ["key", "ends_sha256"])
            out.clear()

    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield from rows()
    if key is not None:
        out.append((key, state.hexdigest()))
    yield from rows()


def end_lists(ends: DataFrame) -> DataFrame:
    """key and ends_sha256, the hash of the key's conversations in numerical order, joined by commas."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ends.where("conv_id is not null").select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = written(ranges.mapInArrow(_chunks, ENDS), "end-chunks")
    return chunks.repartition("key").sortWithinPartitions("key", "part", "no").mapInArrow(_hashed, "key string, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id, depth from 1, digest, n_words) of ``conversations`` (conv_id, each once).

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    salted = {s: F.shiftrightunsigned(F.xxhash64(F.lit(i), F.col("digest"), F.col("depth")), 32) for i, s in enumerate(SUMS)}
    paths = running_sums(turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "digest", "n_words"), ["conv_id"], ["depth"], salted)
    above = [F.col(s) - x for s, x in salted.items()]
    zero = F.lit(0).cast("long")
    paths = paths.select("conv_id", "depth", _key([F.col(s) for s in SUMS], F.col("depth")).alias("key"), _key(above, F.col("depth") - 1).alias("parent_key"), "n_words")
    root = conversations.select("conv_id", zero.alias("depth"), _key([zero] * len(SUMS), zero).alias("key"), F.lit(None).cast("string").alias("parent_key"), zero.alias("n_words"))
    members = written(paths.unionByName(root).withColumn("trie", F.spark_partition_id()), "trie-members")
    tries = 1 + (members.agg(F.max("trie")).first()[0] or 0)

    ends = written(members.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"), F.max("depth").alias("depth")), "trie-ends")
    one = F.lit(1).cast("long")
    partial = members.select("trie", "key", "depth", "parent_key", "n_words", "conv_id", one.alias("n_convs"), zero.alias("n_ends"))
    final = ends.select((F.spark_partition_id() % tries).alias("trie"), "key", "depth", zero.alias("n_convs"), one.alias("n_ends"))
    nodes = written(merged(partial.unionByName(final, allowMissingColumns=True), tries, ["key", "depth"], ["n_convs", "n_ends"], ["conv_id", "parent_key", "n_words"]), "trie-nodes")

    # each node's own part, and what its least member owns above it
    own = nodes.select("key", "depth", "conv_id", ((F.col("n_convs") - 1) * F.col("n_words")).alias("own_saved"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("own_leaves"))
    totals = own.groupBy("conv_id").agg(F.sum("own_saved").alias("saved"), F.sum("own_leaves").alias("leaves"))
    totals = written(totals, "trie-totals")
    same = members.select("conv_id", "trie", "key").withColumnRenamed("conv_id", "member").join(totals, F.col("member").eqNullSafe(F.col("conv_id")))
    rolled = merged(same.select("trie", "key", "saved", "leaves"), tries, ["key"], ["saved", "leaves"], [])
    passed = running_sums(own, ["conv_id"], ["depth"], {"up_saved": F.col("own_saved"), "up_leaves": F.col("own_leaves")})
    passed = passed.select("key", (F.col("up_saved") - F.col("own_saved")).alias("above_saved"), (F.col("up_leaves") - F.col("own_leaves")).alias("above_leaves"))
    children = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    heads = nodes.select("key", "depth", "parent_key", "conv_id", "n_convs")
    n_nodes = nodes.count()
    out = heads.join(rolled, "key").join(passed, "key").join(children, "key", "left").join(end_lists(ends), "key", "left")
    out = join_counted(out, parents, ["parent_key"], "left", n_nodes)
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        (F.col("leaves") - F.col("above_leaves")).alias("n_leaves"),
        (F.col("saved") - F.col("above_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations c that begin with the first h turns of conversation c - c % 20, h = crc32(c) % 4, in place of their own.

    Turns (conv_id, depth, digest, n_words) and all conversations, also those left without a turn.
    """
    c = F.col("conv_id")
    rows = written(numbered, "numbered-turns")
    h = F.when(F.coalesce(c % 20, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(F.crc32(c.cast("string")) % 4)
    convs = written(rows.groupBy("conv_id").agg(F.max("position").alias("n_turns")).withColumn("h", h).withColumn("base", c - c % 20), "conversations")
    first = rows.where((c % 20 == 0) & (F.col("position") <= 3)).select(c.alias("base"), F.col("position").alias("depth"), "digest", "n_words")
    heads = convs.where("h > 0").join(first, "base").where(F.col("depth") <= F.col("h")).select("conv_id", "depth", "digest", "n_words")
    sizes = convs.where(c % 20 == 0).select(c.alias("base"), F.col("n_turns").alias("n_base"))
    short = convs.where("h > 0").join(sizes, "base", "left").select("conv_id", (F.col("h") - F.coalesce("n_base", F.lit(0).cast("long"))).alias("missing")).where("missing > 0")
    short = written(short, "short-bases")
    own = join_counted(rows.where(F.col("position") > h), short, ["conv_id"], "left", short.count())
    own = own.select("conv_id", (F.col("position") - F.coalesce("missing", F.lit(0).cast("long"))).alias("depth"), "digest", "n_words")
    return own.unionByName(heads), convs.select("conv_id")

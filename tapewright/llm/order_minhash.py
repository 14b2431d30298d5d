"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is the sequence of its 5-word shingles, each labelled with how often it occurred before in the text. Each
of ``sketches`` hash functions picks the ``picks`` least labelled shingles and keeps them in text order; documents
that agree on one such tuple are candidates. Agreement needs the same shingles in the same order, so it follows edit
similarity, not only shared vocabulary. Short texts (up to ``EXACT`` shingles), for which such tuples are too few or
too seldom equal, have a key for each of so many least labelled shingles under one hash that texts at the threshold
always share one; texts long enough to be near a short one have both kinds of keys.

Similarity of two documents is m / (a + b - m) with a and b shingles and m the most shingles that align in order
(their longest common subsequence); pairs of ``threshold`` (0.8) or more are linked. The threshold bounds how far
aligned shingles can drift apart, so only a diagonal band is searched. A document's class is its component.

Every pair of texts that share a bucket ends up in one class or is compared:

1. Equal texts are one candidate. In each of ``stars`` rounds every bucket's least member by a hash meets all others
   (a pair for each member at most) and leaves the bucket, as it has been compared with everyone there; linked classes
   become one. Buckets of a single class, and all but one of the buckets with the same members, are done.
2. What is left is dealt by bucket into groups of bounded size, a larger bucket as pairs of blocks of its members. A
   group finds the members that may be near one of another class, by a bound on the shingles two texts can share that
   is never too low (counts of shingles in ``BINS`` bins, as bits). These members only, with their texts, are grouped
   again and compared one by one, two texts in the least bucket that they share; classes that a link joins are not
   compared further. Groups give members and links between classes, never pairs.
3. Buckets of more than ``most_blocks`` blocks are first dealt anew, by the rarest fifth of each text's shingles, one
   of which any two texts at the threshold share.

Pairs, texts and links stay distributed; only the roots of classes that met are renumbered. Texts are told apart by
128 bits of hash; the numbers of texts are 64 of these, and another hash where two texts agree in them.

Defined results: null and empty texts (and texts without words that are equal) are equal texts; texts of fewer than
five words are one shingle; texts of any length are compared whole; repeated rows share a class; a null doc_id is never
a class's id unless the class has no other; extra columns, whatever their names, are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.llm.common import fresh, join_counted, require, tidy, written
from tapewright.llm.components import components, find, unite

WORDS = 5
EXACT = 20  # shingles up to which no near text is missed
BINS, LEVELS = 512, 4
BLOCK_BYTES = 8 << 20  # of texts in a group that compares them
BASE = 0x9E3779B97F4A7C15
U = np.uint64
_powers = [np.ones(1, U), np.ones(1, U)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(2 * n, b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word (a run of bytes other than white space), from sums of powers over the whole text."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    solid = (b != 32) & ((b < 9) | (b > 13))
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(n)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((b.astype(U) + U(1)) * up, dtype=U)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)) if len(starts) else np.zeros(0, U)


def shingles(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if n == 0:
        return words
    k = min(WORDS, n)
    out = np.zeros(n - k + 1, U)
    for i in range(k):
        out = out * U(0x100000001B3) + words[i : n - k + 1 + i]
    return _mix(out)


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles mixed with the number of earlier ones that equal them."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.concatenate([[True], t[1:] != t[:-1]])
    if new.all():
        return s
    at = np.arange(len(t))
    seen = np.empty(len(t), np.int64)
    seen[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(seen > 0, _mix(s + seen.astype(U) * U(BASE)), s)


def sketch(text: str, seeds: np.ndarray, picks: int) -> np.ndarray | None:
    """One key per seed, of the least labelled shingles under that seed in text order; none without words."""
    lab = labelled(shingles(word_hashes(text.encode())))
    return sketch_of(lab, seeds, picks) if len(lab) else None


def keys(text: str, seeds: np.ndarray, picks: int, threshold: float) -> np.ndarray | None:
    """The sketch of a text, and for a short one (or one that a short one can be near to) keys that no near text escapes."""
    lab = labelled(shingles(word_hashes(text.encode())))
    n = len(lab)
    if not n:
        return None
    out = [sketch_of(lab, seeds, picks)] if n > EXACT else []
    if n * threshold <= EXACT + 1e-9:  # two such texts share this many shingles, so one of the others and the next
        out.append(np.sort(_mix(lab ^ U(BASE)))[: n + 1 - math.ceil(n * threshold - 1e-9)])
    return np.concatenate(out)


def sketch_of(lab: np.ndarray, seeds: np.ndarray, picks: int) -> np.ndarray:
    n = len(lab)
    x = (lab[None, :] ^ seeds[:, None]) * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    if n > picks:
        at = np.sort(np.argpartition(x, picks - 1, axis=1)[:, :picks], axis=1)
        got = lab[at]
    else:
        got = np.broadcast_to(lab, (len(seeds), n))
    out = seeds.copy()
    for i in range(got.shape[1]):
        out = _mix(out * U(31) + got[:, i])
    return out


def profile(text: str) -> tuple[int, int, bytes]:
    """What bounds the shingles shared with another text: their number, and how many fall in each bin of hashes.

    Bit b of level t says that bin b has more than t shingles; what the levels leave out is counted as the excess.
    """
    lab = labelled(shingles(word_hashes(text.encode())))
    counts = np.bincount((_mix(lab ^ U(BASE)) % U(BINS)).astype(np.int64), minlength=BINS)
    levels = np.packbits(counts[None, :] > np.arange(LEVELS)[:, None], axis=1)
    return len(lab), int(np.maximum(counts - LEVELS, 0).sum()), levels.tobytes()


def need(n: np.ndarray | int, m: np.ndarray | int, threshold: float) -> np.ndarray | float:
    """The least number of shared shingles at the threshold for texts of ``n`` and ``m``."""
    return threshold * (n + m) / (1 + threshold) - 1e-9


def possible(roots: np.ndarray, sides: np.ndarray | None, n: np.ndarray, excess: np.ndarray, levels: list[bytes], threshold: float) -> np.ndarray:
    """Which members may be near another one of another root (and, if there are two sides, of the other side)."""
    kinds, root = np.unique(roots, return_inverse=True)
    sizes = np.bincount(root)
    order = np.argsort(sizes[root] * len(kinds) + root, kind="stable")  # the largest class last
    root, n, excess = root[order], n[order], excess[order]
    bits = np.frombuffer(b"".join(levels[i] for i in order.tolist()), U).reshape(len(order), -1)
    side = None if sides is None else sides[order]
    hit = np.zeros(len(order), bool)
    for i in range(int(len(order) - sizes.max())):
        other = root[i + 1 :] != root[i]
        if side is not None:
            other &= side[i + 1 :] != side[i]
        other &= np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i]) - 1e-9
        at = i + 1 + np.flatnonzero(other)
        if len(at):
            most = np.bitwise_count(bits[at] & bits[i]).sum(axis=1, dtype=np.int64) + np.minimum(excess[at], excess[i])
            near = at[most >= need(n[at], n[i], threshold)]
            hit[near] = True
            hit[i] |= len(near) > 0
    out = np.zeros(len(order), bool)
    out[order] = hit
    return out


def links_among(roots: list[int], sides: list[int] | None, texts: list[str], threshold: float, here: int = 0, buckets: Sequence[frozenset[int]] | None = None) -> list[tuple[int, int]]:
    """Links between roots that make one class of any two with a pair of texts at the threshold.

    Of the buckets that two texts share (``buckets`` has those of each text) only the least compares them.
    """
    up: dict[int, int] = {}
    own = [shingles(word_hashes(t.encode())) for t in texts]
    sets = [frozenset(labelled(s).tolist()) for s in own]
    lists = [s.tolist() for s in own]
    out = []
    for i, x in enumerate(sets):
        for j in range(i):
            if sides is not None and sides[i] == sides[j] or find(up, roots[i]) == find(up, roots[j]):
                continue
            if buckets is not None and min(buckets[i] & buckets[j]) != here:
                continue
            y = sets[j]
            total = len(x) + len(y)
            least = need(len(x), len(y), threshold)
            if min(len(x), len(y)) < least or len(x & y) < least:
                continue
            if not total:
                near = texts[i] == texts[j]
            else:
                m = alignment(lists[i], lists[j], int(total - 2 * least + 1e-6))
                near = m >= least
            if near:
                out.append((roots[i], roots[j]))
                unite(up, roots[i], roots[j])
    return out


def least_shared(n: Column, threshold: float) -> Column:
    """How many of its n labelled shingles a text shares at least with any text at the threshold.

    However all shingles are ordered, two such texts have one in common among their first n + 1 less this.
    """
    return F.ceil(n * threshold - 1e-9)


def alignment(a: list, b: list, most_unmatched: int) -> int:
    """The longest common subsequence within the band that leaves at most ``most_unmatched`` items unmatched.

    Ends that agree match. The rest is Hyyro's bit-parallel recurrence, a row of the table in one integer; matches
    further from the diagonal than the band are masked, as no alignment through them leaves few enough unmatched.
    """
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < min(hi_a, hi_b) and a[lo] == b[lo]:
        lo += 1
    while min(hi_a, hi_b) > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    same = lo + len(a) - hi_a
    a, b = a[lo:hi_a], b[lo:hi_b]
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    band = (1 << 2 * most_unmatched + 1) - 1 if 2 * most_unmatched + 1 < len(a) + len(b) else 0
    v = full
    for j, y in enumerate(b):
        if m := at.get(y, 0):
            if band:
                shift = j - most_unmatched
                m &= band << shift if shift >= 0 else band >> -shift
            u = v & m
            v = ((v + u) | (v - u)) & full
    return same + len(a) - v.bit_count()


def similarity(x: str, y: str, threshold: float) -> float:
    """Aligned shingles over all shingles of both texts; 0 where the threshold is out of reach."""
    a, b = (shingles(word_hashes(t.encode())).tolist() for t in (x, y))
    total = len(a) + len(b)
    if not total:
        return 1.0
    need = threshold * total / (1 + threshold)
    if sum((Counter(a) & Counter(b)).values()) < need - 1e-9:
        return 0.0
    m = alignment(a, b, int(total - 2 * need + 1e-9))
    return m / (total - m)


def _reps(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, h1, h2, _text): what a row's text is, whatever its length."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).alias("doc_id"), F.xxhash64(t).alias("h1"), F.xxhash64(t, F.lit(1)).alias("h2"), t.alias("_text"))


def numbered(df: DataFrame, twins: DataFrame | None) -> DataFrame:
    """``df`` (with h1 and h2) and a text's number ``u``: h1, but for the ``twins``, other texts of the same h1."""
    if twins is None:
        return df.withColumn("u", F.col("h1"))
    return join_counted(df, twins, ["h1", "h2"], "left", twins.count()).withColumn("u", F.coalesce("twin", "h1")).drop("twin")


def twins_of(texts: DataFrame) -> DataFrame | None:
    """(h1, h2, twin) for all but the first text of each h1 that several texts (h1, h2) have; None if there are none."""
    several = texts.groupBy("h1").agg(F.min("h2").alias("first"), F.max("h2").alias("last")).where("first <> last")
    several = written(several, "twins")
    if not (n := several.count()):
        return None
    return written(join_counted(texts, several, ["h1"], "inner", n).where("h2 <> first").select("h1", "h2", F.xxhash64("h1", "h2").alias("twin")), "twins")


def renumbered(df: DataFrame, moved: DataFrame, n: int) -> DataFrame:
    """``df`` with the roots of classes that became one; ``moved`` has at most ``n`` of them."""
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return join_counted(df, to, ["root"], "left", n).withColumn("root", F.coalesce("to", "root")).drop("to")


def near_classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, sketches: int = 20, picks: int = 5, stars: int = 2, block: int = 2048, most_blocks: int = 16) -> DataFrame:
    """(doc_id, class_id, class_key, h1, h2, copies): a row for each document of ``df`` and text.

    ``class_id`` is the least doc_id of its class, ``class_key`` tells classes apart even without any, and ``copies``
    is how many rows of ``df`` have this doc_id and text.
    """
    require(df, [key, text])
    docs = _reps(df, key, text)
    with tidy(df.sparkSession):
        classes = _classes(docs, threshold, sketches, picks, stars, block, most_blocks)
    rows = docs.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("copies"))
    return rows.join(classes, ["h1", "h2"]).select("doc_id", "class_id", "class_key", "h1", "h2", "copies")


def _classes(docs: DataFrame, threshold: float, sketches: int, picks: int, stars: int, block: int, most_blocks: int) -> DataFrame:
    """(h1, h2, class_id, class_key) of every text."""
    seeds = _mix(np.arange(1, sketches + 1, dtype=U) * U(BASE))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, rows = [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                if (got := keys(t, seeds, picks, threshold)) is not None:
                    made.append(got.view(np.int64))
                    rows.append(i)
            at = pa.array(np.repeat(np.array(rows, np.int64), [len(x) for x in made]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made) if made else np.zeros(0, np.int64)), *(batch.column(c).take(at) for c in ("h1", "h2"))], ["bucket", "h1", "h2"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            ok = pa.array([similarity(p, q, threshold) >= threshold - 1e-12 for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(ok), batch.column("v").filter(ok)], ["u", "v"])

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [profile(t) for t in batch.column("text").to_pylist()]
            own = [pa.array([x[k] for x in made], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("bytes"), *own], ["u", "bytes", "n", "excess", "levels"])

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [labelled(shingles(word_hashes(t.encode()))).view(np.int64) for t in part.column("text").to_pylist()]
                of = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), part.column("u").take(of)], ["bucket", "u"])

    def survivors(frame: pd.DataFrame) -> pd.DataFrame:
        two = None if frame["i"].iloc[0] == frame["j"].iloc[0] else frame["side"].to_numpy()
        hit = possible(frame["root"].to_numpy(), two, *(frame[c].to_numpy() for c in ("n", "excess")), frame["levels"].tolist(), threshold)
        return frame.loc[hit, ["bucket", "u", "root"]]

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        two = None if frame["i"].iloc[0] == frame["j"].iloc[0] else frame["side"].tolist()
        links = links_among(frame["root"].tolist(), two, frame["text"].tolist(), threshold, int(frame["bucket"].iloc[0]), [frozenset(b.tolist()) for b in frame["buckets"]])
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    def split(members: DataFrame, n: int) -> DataFrame:
        """The texts of ``members`` in a bucket for each of their rarest shingles that texts at the threshold can share."""
        own = written(members.select("u", "root").distinct().join(profiles.select("u", "n"), "u"), "rest", n)
        each = written(join_counted(needed, own.select("u"), ["u"], "left_semi", n).select("u", "text").mapInArrow(labels, "bucket long, u long"), "shingles")
        shared = each.join(each.groupBy("bucket").agg(F.count("*").alias("holders")).where("holders > 1"), "bucket")
        of_text = W.partitionBy("u")
        placed = shared.withColumn("k", F.row_number().over(of_text.orderBy("holders", "bucket"))).withColumn("n_shared", F.count("*").over(of_text))
        rare = placed.join(own, "u").where(F.col("k") <= F.col("n_shared") + 1 - least_shared(F.col("n"), threshold))
        return rare.select(F.xxhash64("bucket", F.lit("split")).alias("bucket"), "u", "root")

    def unsettled(members: DataFrame, n: int, once: bool = True) -> DataFrame:
        """Members of the buckets of more than one class (with ``once`` one for each set of members), with size and centre."""
        centre = F.min(F.struct(F.xxhash64("bucket", "u").alias("h"), "u", "root"))
        sets = (F.bit_xor(F.xxhash64("u")).alias("x"), F.bit_xor(F.xxhash64("u", F.lit(1))).alias("y"))
        mixed = members.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size"), centre.alias("c"), *sets).where("a <> b")
        if once:
            mixed = mixed.groupBy("size", "x", "y").agg(F.min_by(F.struct("bucket", "c"), "bucket").alias("o")).select("size", "o.*")
        one = written(mixed.select("bucket", "size", F.col("c.u").alias("v"), F.col("c.root").alias("v_root")), "unsettled", n)
        return written(join_counted(members.select("bucket", "u", "root"), one, ["bucket"], "inner", n), "members", n)

    def dealt(members: DataFrame, blocks: Column) -> DataFrame:
        """``members`` in groups (bucket, i, j) of the pairs of their bucket's blocks, each with its block as ``side``."""
        placed = members.withColumn("blocks", F.greatest(F.lit(1), blocks).cast("int"))
        placed = placed.withColumn("side", F.pmod(F.xxhash64("u", "bucket", F.lit(2)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return placed.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("blocks", "other")

    def merged(roots: DataFrame, members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        n_links = links.count()
        if not n_links:
            return roots, members
        moved = written(components(links), "components", 2 * n_links)
        return written(renumbered(roots, moved, 2 * n_links), "roots", n_nodes), renumbered(members, moved, 2 * n_links)

    found = written(docs.groupBy("h1", "h2").agg(F.min("doc_id").alias("least")), "texts")
    twins = twins_of(found)
    texts = numbered(found, twins)
    # One node for each different text that has words.
    buckets = numbered(docs.select("h1", "h2", "_text").mapInArrow(sketched, "bucket long, h1 long, h2 long").distinct(), twins)
    buckets = written(buckets.select("bucket", "u"), "buckets")
    centre = F.min(F.struct(F.xxhash64("u").alias("h"), "u")).alias("c")
    sizes = written(buckets.groupBy("bucket").agg(F.count("*").alias("size"), centre).where("size > 1").select("bucket", F.col("c.u").alias("v")), "bucket-sizes")
    members = written(buckets.join(sizes, "bucket").select("bucket", "u", F.col("u").alias("root"), "v", F.col("v").alias("v_root")), "members")
    n = members.count()
    roots = written(members.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct(), "roots", n)
    n_nodes = roots.count()
    needed = join_counted(numbered(docs, twins), roots.select(F.col("node").alias("u")), ["u"], "left_semi", n_nodes).groupBy("u").agg(F.first("_text").alias("text"))
    needed = written(needed, "near-texts")
    for star in range(stars if n else 0):
        pairs = written(members.where("root <> v_root").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs", n)
        both = pairs.join(needed.select("u", F.col("text").alias("x")), "u").join(needed.select(F.col("u").alias("v"), F.col("text").alias("y")), "v")
        links = both.select("u", "v", "x", "y").mapInArrow(verified, "u long, v long")
        for end in ("u", "v") if star else ():  # from texts to their classes
            of = roots.select(F.col("node").alias(end), F.col("root").alias("of"))
            links = join_counted(links, of, [end], "inner", n_nodes).drop(end).withColumnRenamed("of", end)
        roots, members = merged(roots, members.where("u <> v").select("bucket", "u", "root"), written(links, "links"))
        members = unsettled(written(members, "left", n), n, once=star + 1 == stars)
        n = members.count()
        if not n:
            break
    if n:
        large = members.where(F.col("size") > block * most_blocks).select("bucket", "u", "root")
        n_large = large.count()
        profiles = join_counted(needed, written(members.select("u").distinct(), "left-nodes", n), ["u"], "left_semi", n)
        profiles = written(profiles.select("u", F.octet_length("text").cast("long").alias("bytes"), "text").mapInArrow(profiled, "u long, bytes long, n long, excess long, levels binary"), "profiles")
        if n_large:
            rest = unsettled(written(split(large, n_large), "split"), n)
            members = members.where(F.col("size") <= block * most_blocks).unionByName(rest)
        given = dealt(members.select("bucket", "u", "root", "size").join(profiles, "u"), F.ceil(F.col("size") / block))
        near = given.groupBy("bucket", "i", "j").applyInPandas(survivors, "bucket long, u long, root long").distinct()
        near = written(near, "near-members")
        n = near.count()
        near = unsettled(near, n)
        of_text = near.groupBy("u").agg(F.collect_list("bucket").alias("buckets")).join(profiles.select("u", "bytes"), "u")
        near = written(near.select("bucket", "u", "root", "size").join(of_text, "u"), "near-members")
        weights = near.groupBy("bucket").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("heavy"))
        near = written(near.join(weights, "bucket").select("bucket", "u", "root", "buckets", F.greatest(F.ceil(4 * F.col("size") / block), "heavy").alias("n_blocks")), "near-members")
        given = dealt(near, F.col("n_blocks")).join(needed, "u")
        links = given.groupBy("bucket", "i", "j").applyInPandas(linked, "u long, v long").distinct()
        roots, _ = merged(roots, members, written(links, "links"))

    named = texts.join(roots.withColumnRenamed("node", "u"), "u", "left").select("h1", "h2", "u", "least", "root")
    least = written(named.where("root is not null").groupBy("root").agg(F.min("least").alias("class_id")), "class-ids")
    return written(named.join(least, "root", "left").select("h1", "h2", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("root", "u").alias("class_key")), "classes", keep=True)


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """``df`` with one row of each class: that of the least doc_id (a null only if there is no other)."""
    classes = near_classes(df, key, text, **how)
    d, a, b, n, h1, h2 = fresh(df.columns, "_d", "_a", "_b", "_n", "_h1", "_h2")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "copies"))
    stay = classes.groupBy("class_key").agg(least.alias("s")).select(F.col("s.doc_id").alias(d), F.col("s.h1").alias(a), F.col("s.h2").alias(b), F.col("s.copies").alias(n))
    stay = written(stay, "stay")
    t = F.coalesce(F.col(text), F.lit(""))
    docs = df.select("*", F.xxhash64(t).alias(h1), F.xxhash64(t, F.lit(1)).alias(h2))
    kept = docs.join(stay, docs[key].eqNullSafe(stay[d]) & (docs[h1] == stay[a]) & (docs[h2] == stay[b]))
    once = kept.where(F.col(n) == 1).select(*df.columns)
    return once.unionByName(kept.where(F.col(n) > 1).dropDuplicates([d, h1, h2]).select(*df.columns))

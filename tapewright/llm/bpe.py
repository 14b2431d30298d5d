"""Byte-level BPE encoding and decoding by merge replay.

Words (matches of the splitting pattern) are merged together, not one by one: an inverted index from token pair to
word positions lets each merge, in rank order, touch every place it applies to at once, and only the neighbours of a
merged place get new index entries.

The words of the whole corpus are counted first (all of them, each once a task and then by shuffle). The commonest, as
many as fit into ``COMMON_BYTES``, are replayed together through one index over all of them, and their ids are
broadcast, which that bound allows. Rarer words are replayed by the slice of texts in which they stand, through the
same index over the slice's words: joining their ids back would shuffle every text once more. Which words are common
changes no id. Through the driver go the rank file and the bounded table of common words.

Defined results: null and empty texts have no ids; texts of any length are encoded whole, repeated rows alike; an empty
table gives an empty result; ids are little-endian unsigned 32-bit integers in a binary column
(``ids_to_array`` gives them as an array); unknown ids decode to null for the row; columns of the same name are
replaced, others pass through whatever their names. The table is read twice, to count and to encode; a row that is
different the second time is still encoded rightly, as a word without a count is replayed like a rare one.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import others, tidy, written

KNOWN_WORDS = 300_000
SLICE_WORDS = 8_000
#: Bound on what the common words and their ids take as Python objects in a worker.
COMMON_BYTES = 32 << 20
#: Words of more characters are not counted but replayed where they stand.
LONGEST_COUNTED = 256
#: Characters of text after which a task hands on what it has counted.
COUNTED_CHARS = 64 << 20
# Runs without white space, with one space before; runs of white space up to such. White space as patterns' \s has it.
_W = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACED_PARTS = rf" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+"
_loaded: dict[tuple, Replay] = {}


class Replay:
    """Merges by rank over a slice of words at a time, with a bounded memory of words already done."""

    def __init__(self, rank_file: bytes, pattern: str, parts: str | None = None, common: bytes | None = None) -> None:
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, rank_file.splitlines()) if t}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.shift = max(self.bytes_of).bit_length()
        self.merges = {
            self.ranks[t[:cut]] << self.shift | self.ranks[t[cut:]]: r
            for t, r in self.ranks.items()
            for cut in range(1, len(t))
            if t[:cut] in self.ranks and t[cut:] in self.ranks
        }  # the rank of a pair is that of its joined bytes
        self.parts_of = re.compile(parts).findall if parts else None
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        table = pa.ipc.open_stream(common).read_all() if common else None
        self.common = dict(zip(*(c.to_pylist() for c in table.columns), strict=True)) if table else {}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = (self.merges.get(int(a) << self.shift | int(b), -1) for a in self.single for b in self.single)
        self.first = np.fromiter(pairs, np.int64, 1 << 16)  # the rank of each pair of bytes

    def start(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]], np.ndarray]:
        """Single-byte tokens of all words, -1 after each; where words end; positions of pairs by rank, and ranks by position."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        place = np.arange(len(data)) + np.repeat(np.arange(len(words)), sizes)
        tok = np.full(int(ends[-1]) + 2, -1, np.int64)
        tok[place] = self.single[data]
        ranks = np.where(np.diff(place) == 1, self.first[data[:-1] << 8 | data[1:]], -1)
        pairs = np.full(len(tok), -1, np.int64)
        pairs[place[:-1]] = ranks
        hit = np.flatnonzero(ranks >= 0)
        hit = hit[np.argsort(ranks[hit], kind="stable")]
        kinds, cuts = np.unique(ranks[hit], return_index=True)
        index = {int(r): at.tolist() for r, at in zip(kinds, np.split(place[hit], cuts[1:]), strict=False)}
        return tok, ends, index, pairs

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word, by merges over all words at once."""
        if not words:
            return []
        shift, merges = self.shift, self.merges.get
        tokens, ends, index, pairs = self.start(words)
        tok = tokens.tolist()  # between words are negative ones; no pair reaches over them
        now = pairs.tolist()  # the rank of the pair that begins at a place, negative for none: what the index has of it before is stale
        n = len(tok)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            at = index.pop(rank)
            at.sort()
            left = rank << shift
            for i in at:
                if now[i] != rank:
                    continue
                j = nxt[i]
                nxt[i] = k = nxt[j]
                prv[k] = i
                tok[i], tok[j], now[j] = rank, -2, -1
                if (c := tok[k]) >= 0 and (r := merges(left | c)) is not None:
                    now[i] = r
                    try:
                        index[r].append(i)
                    except KeyError:
                        heapq.heappush(heap, r)
                        index[r] = [i]
                else:
                    now[i] = -1
                h = prv[i]
                if (c := tok[h]) >= 0 and (r := merges(c << shift | rank)) is not None:
                    now[h] = r
                    try:
                        index[r].append(h)
                    except KeyError:
                        heapq.heappush(heap, r)
                        index[r] = [h]
                else:
                    now[h] = -1
        done = np.array(tok)
        left = done >= 0
        packed = done[left].astype("<u4").tobytes()
        stops = (np.cumsum(left)[ends] * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def is_word(self, part: str) -> bool:
        """ASCII letters alone, with a space before or not, are one word."""
        return not self.parts_of or (part.isascii() and (part[1:] if part[0] == " " else part).isalpha())

    def ids_of(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of different words; those that are no token themselves are merged together."""
        out, merge = {}, []
        for w in words:
            raw = w.encode()
            if (ids := self.common.get(w)) is not None:
                out[w] = ids
            elif (one := self.ranks.get(raw)) is not None:
                out[w] = one.to_bytes(4, "little")
            else:
                merge.append((w, raw))
        out.update(zip((w for w, _ in merge), self.replay([r for _, r in merge]), strict=True))
        return out

    def learn(self, parts: list[str]) -> None:
        """Ids of parts not met before; their words that are new are merged together. Of words that are parts only the part is remembered."""
        split, whole = {}, []
        for p in parts:
            if self.is_word(p):
                whole.append(p)
            else:
                split[p] = self.split(p)
        new = {w for words in split.values() for w in words if w not in self.words}
        if len(self.words) + len(new) > KNOWN_WORDS:
            self.words.clear()
            new = {w for words in split.values() for w in words}
        self.known.update(self.ids_of(whole))
        self.words.update(self.ids_of(new))
        known = self.words
        for p, words in split.items():
            self.known[p] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; texts are taken in slices so that a slice's new parts stay few."""
        pending: list[list[str] | bytes] = []
        fresh: set[str] = set()
        get, split = self.known.get, self.parts_of or self.split
        for text in texts:
            parts = split(text)
            ids = list(map(get, parts))
            if None in ids:
                fresh.update(p for p, i in zip(parts, ids, strict=True) if i is None)
                pending.append(parts)
            else:
                pending.append(b"".join(ids))
            if len(fresh) >= SLICE_WORDS:
                yield from self.flush(pending, fresh)
                pending, fresh, get = [], set(), self.known.get
        yield from self.flush(pending, fresh)

    def flush(self, pending: list[list[str] | bytes], fresh: set[str]) -> Iterator[bytes]:
        if len(self.known) + len(fresh) > KNOWN_WORDS:  # what is still in use comes back from the generation before
            self.before, self.known = self.known, {}
            fresh = {p for parts in pending if isinstance(parts, list) for p in parts}
        new = []
        for p in fresh:
            if (ids := self.before.get(p)) is None:
                new.append(p)
            else:
                self.known[p] = ids
        self.learn(new)
        for parts in pending:
            yield parts if isinstance(parts, bytes) else b"".join(map(self.known.__getitem__, parts))

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of texts with how often they occur, handed on before they are many."""
        parts, chars = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    parts.update((self.parts_of or self.split)(text))
                    chars += len(text)
                if len(parts) > KNOWN_WORDS or chars > COUNTED_CHARS:
                    yield from self.counted(parts)
                    parts, chars = Counter(), 0
        yield from self.counted(parts)

    def counted(self, parts: Counter) -> Iterator[pa.RecordBatch]:
        is_word, words, others = self.is_word, {}, []
        for p, n in parts.items():
            if is_word(p) and len(p) <= LONGEST_COUNTED:
                words[p] = n
            else:
                others.append((p, n))
        for p, n in others:
            for w in self.split(p):
                if len(w) <= LONGEST_COUNTED:
                    words[w] = words.get(w, 0) + n
        if words:
            yield from pa.table({"word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())}).to_batches(10_000)

    def decode(self, ids: bytes) -> bytes | None:
        """The bytes of the tokens, laid end to end from one array that holds those of all tokens; None if an id is unknown."""
        if not hasattr(self, "lengths"):
            self.lengths = np.zeros(max(self.bytes_of) + 1, np.int32)
            for r, t in self.bytes_of.items():
                self.lengths[r] = len(t)
            self.starts = np.zeros((len(self.lengths),), np.int32)
            self.starts[1:] = np.cumsum(self.lengths[:-1])
            self.flat = np.frombuffer(b"".join(self.bytes_of.get(r, b"") for r in range(len(self.lengths))), np.uint8)
        at = np.frombuffer(ids, dtype="<u4")
        if not len(at):
            return b""
        if at.max() >= len(self.lengths) or not (sizes := self.lengths[at]).all():
            return None
        steps = np.ones(int(sizes.sum()), np.int32)  # a byte's place in the array, as the step from the place before
        starts = self.starts[at]
        steps[np.cumsum(sizes[:-1])] = starts[1:] - starts[:-1] - sizes[:-1] + 1
        steps[0] = starts[0]
        return self.flat[np.cumsum(steps, dtype=np.int32)].tobytes()


def replay_of(rank_file: Broadcast, pattern: str, parts: str | None, common: Broadcast | None = None, name: str = "") -> Replay:
    """One Replay a worker process, which later tasks of the process use again; ``name`` tells tables of common words apart."""
    raw = rank_file.value
    key = (len(raw), hash(raw), pattern, parts, name)
    if key not in _loaded:
        while len(_loaded) > 1:  # one that encodes and one that decodes
            _loaded.pop(next(iter(_loaded)))
        _loaded[key] = Replay(raw, pattern, parts, common and common.value)
    return _loaded[key]


class ByteBpe:
    """Encoder and decoder for a rank file; the file (its size is the bound) is broadcast, so executors need no copy.

    ``parts`` may name a simpler pattern whose matches the words of ``pattern`` never reach over and are not split
    differently in; parts of texts that a worker has met are then not split again.
    """

    def __init__(self, spark: SparkSession, rank_path: str, pattern: str, parts: str | None = None) -> None:
        with open(rank_path, "rb") as f:
            self._ranks = spark.sparkContext.broadcast(f.read())
        self._pattern, self._parts = pattern, parts

    def counts(self, df: DataFrame, text: str) -> DataFrame:
        """``word`` and how often it occurs in all texts (``n``); words of over ``LONGEST_COUNTED`` characters are left out."""
        ranks, pattern, parts = self._ranks, self._pattern, self._parts

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return replay_of(ranks, pattern, parts).count(batches)

        return df.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    def common(self, df: DataFrame, text: str, most_bytes: int = COMMON_BYTES) -> pa.Table:
        """The commonest words and their ids, replayed through one index; whole classes of like counts, within ``most_bytes``."""
        ranks, pattern, parts = self._ranks, self._pattern, self._parts
        cost = F.lit(150) + 5 * F.octet_length("word")  # a word, at most an id a byte, and what Python adds

        def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = [w for batch in batches for w in batch.column(0).to_pylist()]
            ids = replay_of(ranks, pattern, parts).ids_of(words)
            yield from pa.table({"word": pa.array(ids.keys(), pa.string()), "ids": pa.array(ids.values(), pa.binary())}).to_batches(10_000)

        with tidy(df.sparkSession):
            words = written(self.counts(df, text).withColumn("level", F.floor(F.log2("n") * 4).cast("int")), "words")
            least, taken = 1 << 30, 0
            for r in words.groupBy("level").agg(F.sum(cost).alias("bytes")).orderBy(F.desc("level")).collect():  # four levels a doubling
                taken += r["bytes"]
                if taken > most_bytes:
                    break
                least = r["level"]
            head = words.where(F.col("level") >= least).select("word")
            return head.repartition(1).mapInArrow(replay, "word string, ids binary").toArrow()  # one index, of bounded size

    def _replay(self, df: DataFrame, text: str):
        """What gives a worker's Replay, with the common words of ``df``."""
        found = self.common(df, text)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, found.schema) as out:
            out.write_table(found)
        common, name = df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex
        ranks, pattern, parts = self._ranks, self._pattern, self._parts
        return lambda: replay_of(ranks, pattern, parts, common, name)

    def encode(self, df: DataFrame, text: str, out: str = "ids") -> DataFrame:
        replay = self._replay(df, text)

        @F.pandas_udf("binary")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            bpe = replay()
            for texts in batches:
                yield pd.Series(list(bpe.encode(["" if t is None else t for t in texts])), dtype=object)

        return df.withColumn(out, encode(F.col(text)))

    def decode(self, df: DataFrame, ids: str, out: str = "decoded") -> DataFrame:
        ranks, pattern, parts = self._ranks, self._pattern, self._parts

        @F.pandas_udf("binary")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            bpe = replay_of(ranks, pattern, parts)
            for given in batches:
                yield pd.Series([None if i is None else bpe.decode(i) for i in given], dtype=object)

        return df.withColumn(out, decode(F.col(ids)))

    def round_trip(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with ``ids`` and what they decode to, ``decoded``, from one pass through one worker."""
        replay = self._replay(df, text)

        @F.pandas_udf("struct<ids:binary,decoded:binary>")
        def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            bpe = replay()
            for texts in batches:
                ids = list(bpe.encode(["" if t is None else t for t in texts]))
                yield pd.DataFrame({"ids": ids, "decoded": [bpe.decode(i) for i in ids]}, dtype=object)

        given = F.struct(*others(df, "ids", "decoded")).alias("given")
        return df.select(given, both(F.col(text)).alias("coded")).select("given.*", "coded.ids", "coded.decoded")


@F.pandas_udf(T.ArrayType(T.LongType()))
def ids_to_array(ids: pd.Series) -> pd.Series:
    return ids.map(lambda b: None if b is None else np.frombuffer(b, dtype="<u4").astype(np.int64))


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")

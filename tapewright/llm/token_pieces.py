"""Documents as token ids, cut into pieces of at most a sequence's length.

Tokenizers whose splitting pattern never reaches over white space are run on the distinct white-space-separated parts
of the texts only. A task takes its texts in chunks: Arrow splits them, numbers the distinct parts and strings the ids of all
parts together, so that Python sees a part once a chunk; a worker remembers the parts it has met. Others get whole texts.

Defined results: null and empty texts are the end id alone, one piece of length 1; texts of any length are encoded
whole; repeated rows are cut alike; an empty table gives an empty result; columns named ``piece``, ``start``,
``length`` or ``ids`` are replaced, others pass through whatever their names.
"""

from __future__ import annotations

import codecs
import json
import os
import string
import struct
import unicodedata
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import fresh, others, require

KNOWN_PARTS = 150_000
CHUNK_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
# Separators that str.split takes for white space and the tokenizers' patterns do not.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
# Byte-level tokenizers write a byte as a letter: as itself in Latin-1 if printable, else as one of those from U+0100 on.
SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
HIDDEN = [b for b in range(0x100) if b not in SHOWN]
BYTE_LETTERS = "".join(chr(b if b in SHOWN else 0x100 + HIDDEN.index(b)) for b in range(0x100))
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
_loaded: dict[tuple, Coder] = {}


class Known(dict):
    """Ids of parts, made when first asked for. Of two generations the older one goes when the newer one is full."""

    def __init__(self, make: Callable[[str], bytes], before: dict[str, bytes] | None = None) -> None:
        super().__init__()
        self.make, self.before = make, before or {}

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            ids = self.make(part)
        self[part] = ids
        return ids

    def next(self) -> Known:
        self.before = {}
        return Known(self.make, self)


class Coder:
    """A tokenizer with a bounded memory of the parts of texts, and of the words in them, that it has met."""

    def __init__(self, tokenizer_json: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        self.tokenizer.encode_special_tokens = True
        config = json.loads(tokenizer_json)
        self.words_of = word_splitter(config)
        self.parts, self.words = Known(self.ids_of_part), Known(self.ids_of_word)
        self.assigned: set[str] = set()
        self.model = self.tokenizer.model

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def normal(self, text: str) -> str | None:
        """The normalised text; None where it has to go in whole."""
        if any(c in text for c in NOT_SPACE):
            return None
        if not text.isascii():
            if new := set(text) - self.assigned:
                if any(unicodedata.category(c) == "Cn" for c in new):
                    return None  # a code point that these tables do not know yet may be a letter in the tokenizer's
                self.assigned |= new
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case goes letter by letter
        return text.lower()

    def ids_of_part(self, part: str) -> bytes:
        """Ids of a part from those of its words; letters alone are one word, and ASCII punctuation alone is one."""
        if part.isascii() and part.isalpha():
            return self.ids_of_word(part)
        head = part.rstrip(string.punctuation)
        if head.isalpha():
            tail = part[len(head) :]
            return self.words[head] + self.words[tail] if tail else self.words[head]
        return b"".join(map(self.words.__getitem__, self.words_of(part)))

    def ids_of_word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else codecs.charmap_decode(word.encode(), "strict", BYTE_LETTERS)[0]
        ids = [t.id for t in self.model.tokenize(letters)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str], end: bytes) -> tuple[pa.Buffer, np.ndarray]:
        """The ids of all texts on end, each text's with ``end`` behind them, and the bytes at which the texts end."""
        normal = [None if self.words_of is None else self.normal(t) for t in texts]
        whole = [i for i, t in enumerate(normal) if t is None]
        split = pc.utf8_split_whitespace(pa.array([t or "" for t in normal], pa.large_string()))
        parts = split.values.dictionary_encode()
        known = list(map(self.parts.__getitem__, parts.dictionary.to_numpy(zero_copy_only=False)))
        tails = [end, *(ids + end for ids in (self.whole([texts[i] for i in whole]) if whole else []))]
        tail = np.full(len(texts), len(known))
        tail[whole] += np.arange(1, len(tails))
        stop = split.offsets.to_numpy()[1:]
        order = np.insert(parts.indices.to_numpy(), stop, tail)
        ids = pa.array(known + tails, pa.large_binary()).take(pa.array(order))
        if len(self.parts) > KNOWN_PARTS:
            self.parts = self.parts.next()
        if len(self.words) > KNOWN_PARTS:
            self.words = self.words.next()
        return ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int64)[stop + np.arange(1, len(texts) + 1)]


def word_splitter(config: dict) -> Callable[[str], list[str]] | None:
    """What finds the words inside a part, if this tokenizer's words never reach over white space."""
    kinds = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
    split, letters = ((config.get("pre_tokenizer") or {}).get("pretokenizers", []) + [{}, {}])[:2]
    pattern = (split.get("pattern") or {}).get("Regex", "")
    fits = kinds == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") and pattern.endswith(r"[^\s\p{L}\p{N}]+") and " " not in pattern
    fits = fits and letters.get("type") == "ByteLevel" and not letters.get("add_prefix_space") and not letters.get("use_regex")
    return regex.compile(pattern).findall if fits else None


def coder_of(tokenizer: Broadcast) -> Coder:
    raw = tokenizer.value
    key = (len(raw), hash(raw))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Coder(raw)
    return _loaded[key]


def pieces_of(coder: Coder, batch: pa.RecordBatch, text: str, mine: list[str], capacity: int, end: bytes) -> Iterator[pa.RecordBatch]:
    """The pieces of a batch, chunk by chunk of its texts."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
    cuts = [*np.flatnonzero(np.diff((np.cumsum(size) - size) // CHUNK_BYTES, prepend=-1)).tolist(), len(size)]
    step, rows = 4 * capacity, max(1, BATCH_BYTES // (4 * capacity))
    for lo, hi in pairwise(cuts):
        chunk = batch.slice(lo, hi - lo)
        ids, ends = coder.encode(["" if t is None else t for t in chunk.column(text).to_pylist()], end)
        begins = np.concatenate([[0], ends[:-1]])
        n = -(-(ends - begins) // step)
        row = np.repeat(np.arange(len(ends)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        places = np.append(begins[row] + piece * step, ends[-1])  # a piece ends where the next one begins
        for k in range(0, len(row), rows):
            at, own, place = pa.array(row[k : k + rows]), piece[k : k + rows], places[k : k + rows + 1]
            offsets = pa.py_buffer((place - place[0]).astype(np.int32))
            cut = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, offsets, ids.slice(place[0], place[-1] - place[0])])
            made = [pa.array(own, pa.int32()), pa.array(own * capacity, pa.int64()), pa.array(np.diff(place) // 4, pa.int64()), cut]
            yield pa.RecordBatch.from_arrays([*(chunk.column(c).take(at) for c in mine), *made], [*mine, "piece", "start", "length", "ids"])


def token_pieces(df: DataFrame, text: str, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row for each piece: the other columns of ``df``, ``piece``, ``start``, ``length`` and ``ids`` (binary, little-endian).

    The tokenizer file (its size is the bound) is broadcast, so executors need no copy of it.
    """
    require(df, [text])
    mine = [c for c in others(df, "piece", "start", "length", "ids") if c != text]
    (given,) = fresh(mine, "_text")
    with open(tokenizer_path, "rb") as f:
        tokenizer = df.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer)
        for batch in batches:
            yield from pieces_of(coder, batch, given, mine, capacity, end)

    schema = df.select(*mine).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")
    return df.select(*mine, F.col(text).alias(given)).mapInArrow(cut, schema)

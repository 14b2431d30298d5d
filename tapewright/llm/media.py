"""Media columns: ISO base media containers as binary columns.

``with_media`` stores a text's bytes as 8-bit grey frames of 8 x 8 (64 bytes a sample) in an ISO container;
``with_media_info`` walks the nested boxes of any container, decodes its sample tables (and the runs of its movie
fragments) and gives codec, duration and the byte ranges of keyframes without touching the media payload;
``with_payload`` reads the stored samples back through those tables. All read the first video track, or the first track
where there is none.

Defined results: a null or empty text is padded to one frame; texts of any length that a 4 GB container holds are one
payload; a container that cannot be read (truncated, no track, tables that say more than the file holds) is no error
but has a null struct, a null payload and a null feature; what follows a box's last whole inner box is passed over;
repeated rows and equal texts have equal values; an empty table gives an empty result; columns of the same name are
replaced, others pass through whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = 64
DEEPEST = 16  # boxes of the format nest eight deep
FPS = 25
KEYFRAME_EVERY = 16
SAMPLES_PER_CHUNK = 32
# Fixed values of the ISO base media file format: boxes that hold only other boxes.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"])
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
RANGE = T.StructType().add("offset", "long").add("length", "long")
INFO = T.StructType().add("codec", "string").add("width", "integer").add("height", "integer").add("timescale", "long").add("duration", "long").add("seconds", "double").add("n_samples", "long").add("keyframes", T.ArrayType(RANGE))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def mux(payload: bytes) -> bytes:
    """A container with one video track of raw grey frames; ``len(payload)`` must be a positive multiple of 64."""
    n, left = divmod(len(payload), UNIT)
    if left or not n:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    whole, rest = divmod(n, SAMPLES_PER_CHUNK)
    n_chunks = whole + bool(rest)
    runs = ([(1, SAMPLES_PER_CHUNK, 1)] if whole else []) + ([(whole + 1, rest, 1)] if rest else [])
    keys = np.arange(1, n + 1, KEYFRAME_EVERY, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H16xHH", 1, 8, 8), struct.pack(">IIIH32xHh", 0x480000, 0x480000, 0, 1, 40, -1))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomqt  ")

    def moov(first: int) -> bytes:
        offsets = (first + np.arange(n_chunks, dtype=np.int64) * SAMPLES_PER_CHUNK * UNIT).astype(">u4")
        stbl = box(
            b"stbl",
            full_box(b"stsd", 0, struct.pack(">I", 1), entry),
            full_box(b"stts", 0, struct.pack(">III", 1, n, 1)),
            full_box(b"stss", 0, struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", 0, struct.pack(">II", UNIT, n)),
            full_box(b"stco", 0, struct.pack(">I", n_chunks), offsets.tobytes()),
        )
        dinf = box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1)))
        minf = box(b"minf", full_box(b"vmhd", 1, bytes(8)), dinf, stbl)
        mdia = box(
            b"mdia",
            full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, FPS, n, 0x55C4, 0)),
            full_box(b"hdlr", 0, struct.pack(">I4s12x", 0, b"vide"), b"\0"),
            minf,
        )
        tkhd = full_box(b"tkhd", 7, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), MATRIX, struct.pack(">II", 8 << 16, 8 << 16))
        mvhd = full_box(b"mvhd", 0, struct.pack(">IIIIIH10x", 0, 0, FPS, n, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = ftyp + moov(0)
    first = len(head) + 8
    return ftyp + moov(first) + box(b"mdat", payload)


def walk(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """Every box as (path, its start, start of its body, end), outer boxes first; media data is passed over by its size alone."""
    open_boxes: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while open_boxes:
        start, end, path = open_boxes.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box is cut short")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            if path:  # what follows the boxes of a box, such as the zero word after user data
                continue
            raise ValueError("a box reaches beyond the file")
        open_boxes.append((stop, end, path))
        inner = (*path, kind)
        yield inner, start, body, stop
        if kind in CONTAINERS and len(path) < DEEPEST:
            open_boxes.append((body, stop, inner))


class Fields:
    """The fields of a full box, read one after another and never beyond its end."""

    def __init__(self, data: memoryview, start: int, stop: int) -> None:
        self.data, self.at, self.stop = data, start, stop
        word = self.ints(1)[0]
        self.version, self.flags = int(word) >> 24, int(word) & 0xFFFFFF

    def ints(self, count: int, width: int = 4) -> np.ndarray:
        if count < 0 or self.at + count * width > self.stop:
            raise ValueError("a table is cut short")
        out = np.frombuffer(self.data, dtype=">u8" if width == 8 else ">u4", count=count, offset=self.at).astype(np.int64)
        self.at += count * width
        return out

    def one(self, width: int = 4) -> int:
        return int(self.ints(1, width)[0])


class Track:
    """Sample tables of a container's first video track, or its first track, fragments included."""

    def __init__(self, media: bytes) -> None:
        data = memoryview(media)
        tracks: list[dict[bytes, tuple[int, int]]] = []
        fragments: list[tuple[int, list[tuple[bytes, int, int]]]] = []
        defaults: dict[int, list[int]] = {}
        for path, begin, start, stop in walk(data):
            if path == (b"moof",):
                fragments.append((begin, []))
            elif path[:1] == (b"moof",) and fragments:
                fragments[-1][1].append((path[-1], start, stop))
            elif path[-1] == b"trak":
                tracks.append({})
            elif path[-1] == b"trex":
                number, *rest = Fields(data, start, stop).ints(5).tolist()
                defaults[number] = rest
            elif tracks and b"trak" in path:
                tracks[-1].setdefault(path[-1], (start, stop))
        whole = [t for t in tracks if b"mdhd" in t and b"stsd" in t]
        at = next((t for t in whole if b"vmhd" in t), whole[0] if whole else None)
        if at is None:
            raise ValueError("no track")
        self.data, self.at = data, at
        head = Fields(data, *at[b"mdhd"])
        width = 8 if head.version else 4
        head.ints(2, width)
        self.timescale, self.duration = head.one(), head.one(width)
        first = at[b"stsd"][0] + 8
        if first + 8 > at[b"stsd"][1]:
            raise ValueError("no sample description")
        self.codec = bytes(data[first + 4 : first + 8]).decode("latin-1")
        self.width, self.height = struct.unpack_from(">HH", data, first + 32) if b"vmhd" in at and first + 36 <= at[b"stsd"][1] else (0, 0)
        self.sizes, self.offsets, self.keys = self.stored() if b"stsz" in at else (np.zeros(0, np.int64),) * 3
        if fragments:
            self.add(fragments, defaults)
        if len(self.sizes) and (int((self.offsets + self.sizes).max()) > len(data) or int(self.offsets.min()) < 0):
            raise ValueError("samples reach beyond the file")
        if len(self.keys) and (int(self.keys.max()) >= len(self.sizes) or int(self.keys.min()) < 0):
            raise ValueError("a key sample does not exist")

    def fields(self, kind: bytes) -> Fields:
        return Fields(self.data, *self.at[kind])

    def stored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, offsets and key samples of the movie's own samples."""
        table = self.fields(b"stsz")
        size, n = table.one(), table.one()
        if n > len(self.data):  # as many samples as the file has bytes at most
            raise ValueError("more samples than bytes")
        sizes = np.full(n, size, dtype=np.int64) if size else table.ints(n)
        table = self.fields(b"co64" if b"co64" in self.at else b"stco")
        chunks = table.ints(table.one(), 8 if b"co64" in self.at else 4)
        table = self.fields(b"stsc")
        runs = table.ints(3 * table.one()).reshape(-1, 3)
        spans = np.diff(np.append(runs[:, 0], len(chunks) + 1))
        if (spans < 0).any() or len(runs) and (runs[0, 0] != 1 or int((spans * runs[:, 1]).sum()) != n) or not len(runs) and n:
            raise ValueError("chunks and samples disagree")
        per_chunk = np.repeat(runs[:, 1], spans)
        before = np.cumsum(sizes) - sizes
        first_of_chunk = np.repeat(np.cumsum(per_chunk) - per_chunk, per_chunk)
        offsets = np.repeat(chunks, per_chunk) + before - before[first_of_chunk] if n else before
        if b"stss" not in self.at:
            return sizes, offsets, np.arange(n)
        table = self.fields(b"stss")
        return sizes, offsets, table.ints(table.one()) - 1

    def add(self, fragments: list[tuple[int, list[tuple[bytes, int, int]]]], defaults: dict[int, list[int]]) -> None:
        """The samples of movie fragments, after the movie's own; flags say which fields a box has."""
        head = self.fields(b"tkhd")
        head.ints(2, 8 if head.version else 4)
        mine = head.one()
        sizes, offsets, keys, ticks = [self.sizes], [self.offsets], [self.keys], 0
        n = len(self.sizes)
        for moof, boxes in fragments:
            base, own, end = moof, None, moof
            for kind, start, stop in boxes:
                if kind == b"tfhd":
                    f = Fields(self.data, start, stop)
                    own = f.one() == mine
                    _, *usual = defaults.get(mine, [1, 0, 0, 0])
                    base = f.one(8) if f.flags & 1 else moof
                    end = base
                    if f.flags & 2:
                        f.one()
                    usual = [f.one() if f.flags & bit else u for bit, u in zip((8, 16, 32), usual, strict=True)]
                elif kind == b"trun" and own is not None:
                    f = Fields(self.data, start, stop)
                    count = f.one()
                    at = base + (f.one() + (1 << 31)) % (1 << 32) - (1 << 31) if f.flags & 1 else end
                    first = f.one() if f.flags & 4 else None
                    has = [f.flags & bit for bit in (0x100, 0x200, 0x400, 0x800)]
                    if count > len(self.data):
                        raise ValueError("more samples than bytes")
                    rows = f.ints(count * sum(map(bool, has))).reshape(count, -1)
                    columns = iter(rows.T)
                    dur, size, flag = (next(columns) if h else np.full(count, u, np.int64) for h, u in zip(has, usual, strict=False))
                    if first is not None and count:
                        flag = np.concatenate([[first], flag[1:]])
                    end = at + int(size.sum())
                    if own:
                        sizes.append(size)
                        offsets.append(at + np.cumsum(size) - size)
                        keys.append(n + np.flatnonzero(flag & 0x10000 == 0))  # not marked as a sample that needs others
                        n, ticks = n + count, ticks + int(dur.sum())
        self.sizes, self.offsets, self.keys = map(np.concatenate, (sizes, offsets, keys))
        if int(self.sizes.sum()) > len(self.data):
            raise ValueError("samples of more bytes than the file has")
        self.duration += ticks

    def info(self) -> dict:
        return {
            "codec": self.codec,
            "width": self.width,
            "height": self.height,
            "timescale": self.timescale,
            "duration": self.duration,
            "seconds": self.duration / self.timescale if self.timescale else None,
            "n_samples": len(self.sizes),
            "keyframes": [{"offset": o, "length": n} for o, n in zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist(), strict=True)],
        }

    def read(self, media: bytes) -> bytes:
        """All samples in order; neighbouring ones are read as one range."""
        if not len(self.sizes):
            return b""
        ends = self.offsets + self.sizes
        breaks = np.flatnonzero(self.offsets[1:] != ends[:-1]) + 1
        firsts, lasts = np.append(0, breaks), np.append(breaks, len(ends)) - 1
        return b"".join(media[a:b] for a, b in zip(self.offsets[firsts].tolist(), ends[lasts].tolist(), strict=True))


def track(media: bytes | None) -> Track | None:
    try:
        return Track(media) if media else None
    except (ValueError, KeyError, IndexError, OverflowError, struct.error):
        return None


@F.pandas_udf(T.BinaryType())
def _mux(payload: pd.Series) -> pd.Series:
    return payload.map(mux)


@F.pandas_udf(INFO)
def _probe(media: pd.Series) -> pd.DataFrame:
    none = dict.fromkeys(["codec", "width", "height", "timescale", "duration", "seconds", "n_samples", "keyframes"])
    found = [(t.info() if (t := track(m)) else none) for m in media]
    return pd.DataFrame(found, columns=list(none)).astype({"width": "Int32", "height": "Int32", "timescale": "Int64", "duration": "Int64", "n_samples": "Int64"})


@F.pandas_udf(T.BinaryType())
def _payload(media: pd.Series) -> pd.Series:
    return media.map(lambda m: t.read(m) if (t := track(m)) else None)


@F.pandas_udf(T.StringType())
def _digest(media: pd.Series) -> pd.Series:
    """Codec, frame size, duration, samples, and count and checksum of the keyframe ranges, from the tables alone."""

    def one(m: bytes) -> str | None:
        if (t := track(m)) is None:
            return None
        ranges = np.stack([t.offsets[t.keys], t.sizes[t.keys]], axis=1).astype("<i8").tobytes()
        return f"{t.codec.strip()}/{t.width}x{t.height}/{t.duration}:{t.timescale}/{len(t.sizes)}/{len(t.keys)}:{zlib.crc32(ranges):08x}"

    return media.map(one)


def padded(data: Column) -> Column:
    """Zero bytes appended up to a positive multiple of 64."""
    n = F.octet_length(data)
    return F.rpad(data, F.greatest(F.lit(UNIT), F.ceil(n / UNIT) * UNIT).cast("int"), F.lit(b"\0"))


def with_media(df: DataFrame, text: str, out: str = "media") -> DataFrame:
    """``df`` and the text's UTF-8 bytes, padded, as a container column."""
    return df.withColumn(out, _mux(padded(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))))


def with_media_info(df: DataFrame, media: str, out: str = "media_info") -> DataFrame:
    return df.withColumn(out, _probe(F.col(media)))


def with_payload(df: DataFrame, media: str, out: str = "payload") -> DataFrame:
    return df.withColumn(out, _payload(F.col(media)))


def with_feature(df: DataFrame, media: str, out: str = "feature") -> DataFrame:
    return df.withColumn(out, _digest(F.col(media)))

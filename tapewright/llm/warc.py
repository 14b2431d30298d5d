"""A Spark data source for WARC archives, read and written.

Reading plans partitions from the files' sizes (a file is read by one task, so archives should be rolled at some 64 MB,
as the writer does), takes equality and membership filters on record type and header
columns into the scan, parses each record's headers first and decodes a payload only if the record passes and payloads
are asked for. Records that do not pass are stepped over: by seeking in plain files, and in compressed ones by the
skip length that the writer leaves in each member's extra field (members without one are inflated and dropped).

Writing makes one gzip member a record, rolls to a new file at ``file_bytes``, and gives files their final names only
once the whole job has committed, so lost or repeated tasks leave no half files among the results.

    spark.dataSource.register(WarcSource)            # or warc.register(spark), which also turns filter push-down on
    spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'response'")
    df.write.format("warc").mode("append").save(path)

Defined results: an empty or missing folder reads as no rows; null header values are not written and read as null;
control characters in header values are percent-encoded; a null payload is written as an empty one; repeated rows are
records of their own; payloads of any length are written and read whole; values of a header that is repeated are joined
by ", " and lines that go on a header belong to it; payloads sent in chunks are put together, compressed contents stay
as they are; an HTTP block without an empty line is all payload; a record whose own headers cannot be parsed ends its
file with an error; columns beyond the schema, whatever their names, are not written.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

# Fixed names of the WARC 1.1 and HTTP formats.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMN_OF = {
    "WARC-Record-ID": "record_id",
    "WARC-Type": "record_type",
    "WARC-Target-URI": "target_uri",
    "WARC-Date": "date",
    "WARC-Payload-Digest": "payload_digest",
    "WARC-Refers-To": "refers_to",
    "Content-Type": "content_type",
}
HEADER_OF = {c.lower(): h for h, c in COLUMN_OF.items()}
LOWER = {h.lower(): c for h, c in COLUMN_OF.items()}
SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_type string, "
    "content_length long, http_length long, headers map<string,string>, payload binary, file string, offset long"
)
ARROW = pa.schema(
    [(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "content_type")]
    + [("content_length", pa.int64()), ("http_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())]
)
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
FIRST_READ = 16 << 10
NEXT = b"\r\n\r\nWARC/"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


@dataclass
class FilesPartition(InputPartition):
    files: list[str] = field(default_factory=list)


class Member:
    """One gzip member, inflated as far as asked; knows where the next member begins without inflating the rest."""

    def __init__(self, f: pa.NativeFile, start: int) -> None:
        self.f, self.start, self.data, self.done = f, start, bytearray(), False
        f.seek(start)
        raw = f.read(FIRST_READ)
        self.skip = None
        if raw[3] & 4:
            (n,) = struct.unpack_from("<H", raw, 10)
            extra = raw[12 : 12 + n]
            while len(extra) >= 4:
                size = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and size == 8:
                    self.skip = struct.unpack_from("<I", extra, 4)[0]
                extra = extra[4 + size :]
        self.z = zlib.decompressobj(31)
        self.raw = raw
        self.read = len(raw)

    def more(self) -> bool:
        if self.done:
            return False
        if not self.raw:
            self.f.seek(self.start + self.read)
            self.raw = self.f.read(FIRST_READ * 16)
            self.read += len(self.raw)
            if not self.raw:
                raise ValueError("a record is cut short")
        self.data += self.z.decompress(self.raw, FIRST_READ * 16)
        self.raw = self.z.unconsumed_tail
        if self.z.eof:
            self.done, self.end = True, self.start + self.read - len(self.z.unused_data)
        return True

    def upto(self, n: int) -> None:
        while len(self.data) < n and self.more():
            pass

    def next_start(self) -> int:
        if not self.done and self.skip:
            return self.start + self.skip
        while not self.done:
            self.data.clear()
            self.more()
        return self.end


class Plain:
    """A record of an uncompressed file."""

    def __init__(self, f: pa.NativeFile, start: int) -> None:
        self.f, self.start, self.data, self.length = f, start, bytearray(), None

    def more(self) -> bool:
        self.f.seek(self.start + len(self.data))
        got = self.f.read(FIRST_READ)
        self.data += got
        return bool(got)

    def upto(self, n: int) -> None:
        if len(self.data) < n:
            self.f.seek(self.start + len(self.data))
            self.data += self.f.read(n - len(self.data))

    def next_start(self) -> int:
        return self.start + self.length

    def seek_next(self, after: int) -> None:
        """Length up to what looks like the next record, or the end of the file."""
        at = after - 4
        while (found := self.data.find(NEXT, at)) < 0 and self.more():
            at = max(at, len(self.data) - FIRST_READ - len(NEXT))
        self.length = len(self.data) if found < 0 else found + 4


def _headers(record: Member | Plain) -> tuple[dict[str, str], int]:
    while (end := record.data.find(b"\r\n\r\n")) < 0:
        if not record.more():
            raise ValueError("a record's headers are cut short")
    head = bytes(record.data[:end])
    first, _, rest = head.partition(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("a record does not begin with a WARC version")
    return fields(rest.decode("utf-8", "replace")), end + 4


def fields(lines: str) -> dict[str, str]:
    """Header lines by name: lines that begin with a space go on, and values of one name (in any case) are joined."""
    out: dict[str, str] = {}
    spelled: dict[str, str] = {}
    name = None
    for line in lines.split("\r\n"):
        if line[:1] in (" ", "\t") and name is not None:
            out[name] = f"{out[name]} {line.strip()}".strip()
            continue
        key, colon, value = line.partition(":")
        if not colon:
            name = None
            continue
        name = spelled.setdefault(key.strip().lower(), key.strip())
        out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def unchunked(body: bytes) -> bytes:
    """A body sent in chunks; as it is where it is not."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return body
        if size <= 0:
            return b"".join(out) if size == 0 else body
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return body


def _length(headers: dict[str, str]) -> int | None:
    said = next((v for k, v in headers.items() if k.lower() == "content-length"), "0")
    return int(said) if said.isascii() and said.isdigit() and len(said) < 19 else None


def records(path: str, wanted: dict[str, set], payloads: bool, lenient: bool = False) -> Iterator[dict]:
    """Rows of one file; ``wanted`` maps columns to the values that pass.

    A record whose length is no number ends the scan, or with ``lenient`` has neither length nor payload.
    """
    fs, name = _open(path)
    size = fs.get_file_info(name).size
    with fs.open_input_file(name) as f:
        at, gz = 0, size >= 2 and f.read_at(2, 0) == b"\x1f\x8b"
        while at < size:
            record = Member(f, at) if gz else Plain(f, at)
            headers, body = _headers(record)
            row = {c: None for c in ARROW.names} | {LOWER[k.lower()]: v for k, v in headers.items() if k.lower() in LOWER}
            length = _length(headers)
            if length is None:
                if not lenient:
                    raise ValueError(f"{path}: the record at {at} has a length that is no number")
                if not gz:
                    record.seek_next(body)
                if all(row[c] in values for c, values in wanted.items()):
                    yield row | {"headers": list(headers.items()), "file": path, "offset": at}
                at = record.next_start()
                continue
            if not gz:
                record.length = body + length + 4
            if all(row[c] in values for c, values in wanted.items()):
                row |= {"content_length": length, "headers": list(headers.items()), "file": path, "offset": at}
                http = (row["content_type"] or "").startswith("application/http")
                start, chunked = body, False
                if http:
                    stop = body + length
                    while (end := record.data.find(b"\r\n\r\n", body, stop)) < 0 and len(record.data) < stop and record.more():
                        pass
                    if end >= 0:
                        start = end + 4
                        said = {k.lower(): v for k, v in fields(bytes(record.data[body:end]).decode("latin-1").partition("\r\n")[2]).items()}
                        sent = said.get("content-length", "").split(",")[0].strip()
                        row["http_length"] = int(sent) if sent.isascii() and sent.isdigit() and len(sent) < 19 else None
                        chunked = said.get("transfer-encoding", "").lower() == "chunked"
                if payloads and row["record_type"] != "revisit":
                    record.upto(body + length)
                    row["payload"] = bytes(record.data[start : body + length])
                    if chunked:
                        row["payload"] = unchunked(row["payload"])
                yield row
            at = record.next_start()


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() != "false"
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.lenient = options.get("bad_records", "fail").lower() == "null"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADER_OF:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Files in size order, small ones together up to ``partition_bytes``."""
        fs, name = _open(self.path)
        scheme = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        info = fs.get_file_info(name)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(name, recursive=True, allow_not_found=True))
        files = sorted((-f.size, f.path) for f in found if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        out, held = [], 0
        for size, path in files:
            if not out or held - size > self.bytes:
                out.append(FilesPartition([]))
                held = 0
            out[-1].files.append(scheme + path)
            held -= size
        return out or [FilesPartition([])]

    def read(self, partition: FilesPartition) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in partition.files:
            for row in records(path, self.wanted, self.payloads, self.lenient):
                rows.append(row)
                held += 512 + len(row["payload"] or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def member(row: dict, level: int = 1) -> bytes:
    """One compressed record; its extra field holds the member's and the record's length."""
    kind = row.get("record_type") or "resource"
    payload = row.get("payload") or b""
    http = kind in ("response", "revisit")
    length = row.get("http_length")
    block = b"" if not http else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if length is None else length)
    if kind != "revisit":
        block += payload
    head = [(h, _clean(str(row[c]))) for h, c in COLUMN_OF.items() if c != "content_type" and row.get(c) is not None]
    if kind == "revisit":
        head.append(("WARC-Profile", REVISIT_PROFILE))
    head.append(("Content-Type", "application/http; msgtype=response" if http else row.get("content_type") or "application/octet-stream"))
    head.append(("Content-Length", str(len(block))))
    raw = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    extra_size = 12
    total = 12 + extra_size + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", extra_size) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", PARTITION_BYTES))
        self.job = uuid.uuid4().hex  # made once on the driver, so that the job's files can be told

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        out, files, size = None, [], 0
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                if out is None:
                    final = f"{base}/{self.job}-{uuid.uuid4().hex}.warc.gz"
                    files.append((final + ".inprogress", final))
                    out, size = fs.open_output_stream(files[-1][0], compression=None), 0
                data = member(row)
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _open(self.path)
        with ThreadPoolExecutor(32) as pool:
            list(pool.map(lambda pair: fs.move(*pair), [pair for m in messages if m for pair in m.files]))
        self.clear(fs, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear(*_open(self.path))

    def clear(self, fs: pafs.FileSystem, base: str) -> None:
        """Take away what tasks of this job that failed or ran twice have left."""
        left = [f.path for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".inprogress") and f.base_name.startswith(self.job)]
        with ThreadPoolExecutor(32) as pool:
            list(pool.map(fs.delete_file, left))


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

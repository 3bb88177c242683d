"""WARC archives: writing with segmentation and chunked transfer framing, and reading back.

A record whose block is longer than ``SEGMENT_BYTES`` is cut: the first part stays in the record,
the others become continuation records that name it as their origin.  Reading groups all parts by
the origin's identifier, orders them by segment number, verifies the numbers and the total length,
takes the HTTP head off and decodes the chunked transfer framing.

Each record is a gzip member of its own, so that readers can seek to it, and each file starts with a
``warcinfo`` record.  Archives go through Spark's text writer and come back through its binary reader,
so any store that Spark can use will do.  The writer puts a separator after each value: it is the zero
byte in which a member of less than 16 MB ends.  A file holds at most ``RECORDS_PER_FILE`` records of
bounded size; its name ends in ``.warc.gz``.

Defined cases: a null payload is an empty one, a null address leaves the header out.  Rows that are
repeated are written and read as often as they occur.  A record that lacks a part, or whose parts
contradict each other, the total length, the chunk framing or the payload's digest, is returned with a
null payload and the reason in ``error``; so is a truncated last record.  A record without an identifier is known by
its place.  An empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4096
RECORDS_PER_FILE = 2048
_END = b"\r\n"
_MEMBER_BYTES = 1 << 24
_LEVEL = 6
PART_SCHEMA = "origin string, number long, total long, type string, uri string, refers_to string, digest string, block binary, error string"
RECORD_SCHEMA = "record_id string, type string, uri string, refers_to string, digest string, segments long, payload binary, error string"


class FramingError(ValueError):
    """A block that breaks the rules of its framing."""


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer coding."""
    parts = []
    for start in range(0, len(payload), size):
        piece = payload[start : start + size]
        parts += [b"%x" % len(piece), _END, piece, _END]
    return b"".join([*parts, b"0", _END, _END])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(_END, at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            raise FramingError("bad chunk size")
        n, at = int(size, 16), end + 2
        if n == 0:
            break
        if body[at + n : at + n + 2] != _END:
            raise FramingError("chunk of another length")
        parts.append(body[at : at + n])
        at += n + 2
    while (end := body.find(_END, at)) != at:  # trailers
        if end < 0:
            raise FramingError("no end of the chunks")
        at = end + 2
    if at + 2 != len(body):
        raise FramingError("bytes after the last chunk")
    return b"".join(parts)


def _plain(value: str) -> bytes:
    """A header value on one line: controls and blanks are percent-encoded."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], value.encode("utf-8", "replace"))


def _record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(name + b": " + value for name, value in headers), b"Content-Length: %d" % len(block)]
    return _END.join(lines) + _END + _END + block


def records(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The WARC records of one capture, without the line ends that close each."""
    name = b"<" + _plain(record_id) + b">"
    common = [(b"WARC-Date", date.encode()), *([(b"WARC-Target-URI", _plain(uri))] if uri is not None else [])]
    shared = [*common, (b"WARC-Payload-Digest", b"sha1:" + _plain(digest)), (b"Content-Type", b"application/http;msgtype=response")]
    if refers_to is not None:
        profile = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head = [(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", name), (b"WARC-Refers-To", b"<" + _plain(refers_to) + b">"), (b"WARC-Profile", profile)]
        yield _record([*head, *shared], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cut = len(block) > segment
    head = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", name)]
    yield _record([*head, *shared, *([(b"WARC-Segment-Number", b"1")] if cut else [])], block[:segment])
    for number, start in enumerate(range(segment, len(block), segment), 2):
        last = start + segment >= len(block)
        head = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", b"<%s;segment=%d>" % (name[1:-1], number)), (b"WARC-Segment-Origin-ID", name), (b"WARC-Segment-Number", b"%d" % number)]
        yield _record([*head, *common, *([(b"WARC-Segment-Total-Length", b"%d" % len(block))] if last else [])], block[start : start + segment])


def warcinfo(record_id: str, date: str) -> bytes:
    """The record that tells what made a file."""
    head = [(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<" + _plain(record_id) + b">"), (b"WARC-Date", date.encode()), (b"Content-Type", b"application/warc-fields")]
    return _record(head, b"software: tabulon\r\nformat: WARC File Format 1.1\r\n")


def member(record: bytes) -> bytes:
    """A record and the line ends that close it as a gzip member."""
    whole = record + _END + _END
    if len(whole) >= _MEMBER_BYTES:
        raise ValueError("a record of 16 MB or more; write smaller segments")
    return gzip.compress(whole, _LEVEL, mtime=0)


def write_archives(captures: DataFrame, path: str, segment: int = SEGMENT_BYTES, per_file: int = RECORDS_PER_FILE) -> None:
    """Write (record_id, uri, payload binary, digest, refers_to) rows as gzipped WARC files; a row with refers_to is a revisit."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            held, size = [], 0
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                for record in records(row[0], row[1], row[2] or b"", row[3], row[4], date, segment):
                    if made % per_file == 0:  # the writer begins a file here
                        held.append(member(warcinfo(f"urn:file:{partition}:{made // per_file}", date))[:-1])
                        made += 1
                    held.append(member(record)[:-1])
                    made += 1
                    size += len(held[-1])
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    lines = captures.select("record_id", "uri", "payload", "digest", "refers_to").mapInArrow(run, "value binary")
    writer = lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0")
    writer.option("compression", "none").option("maxRecordsPerFile", per_file).text(path)
    _rename(captures.sparkSession, path)


def _rename(spark: SparkSession, path: str) -> None:
    """Let the files' names tell what they are."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in store.listStatus(folder) if f.getPath().getName().endswith(".txt")]
    with ThreadPool(8) as pool:
        pool.map(lambda p: store.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, p.getName().removesuffix(".txt") + ".warc.gz")), old)


def _inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of a plain or gzipped file, piece by piece; gzip may have several members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        stream, fed = zlib.decompressobj(31), 0
        while fed < len(content) and not stream.eof:
            yield stream.decompress(content[fed : fed + (1 << 16)])
            fed += 1 << 16
        content = stream.unused_data + content[fed:] if stream.eof else b""


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Header fields (lower-case names), block and whether it is complete, of each record of a file."""
    pieces, held = _inflated(content), bytearray()

    def more() -> bool:
        for piece in pieces:
            held.extend(piece)
            return True
        return False

    while True:
        while held[:1] in (b"\r", b"\n"):
            del held[: len(held) - len(held.lstrip(b"\r\n"))]
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            while held[:1] in (b"\r", b"\n"):
                del held[: len(held) - len(held.lstrip(b"\r\n"))]
        if end < 0:
            return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        length = fields.get("content-length", "")
        n = int(length) if length.isdecimal() else 0
        while len(held) < end + 4 + n and more():
            pass
        block = bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n]
        yield fields, block, len(block) == n and length.isdecimal() and lines[0].startswith("WARC/")


def _name(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isdecimal() and len(value) < 19 else None


def parts(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives as a part of its origin, which is the record itself if it isn't a continuation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), *((n, pa.string()) for n in ("type", "uri", "refers_to", "digest")), ("block", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, size = [], 0
                for place, (fields, block, whole) in enumerate(parse(content or b"")):
                    origin = _name(fields.get("warc-segment-origin-id") or fields.get("warc-record-id")) or f"{file}#{place}"
                    digest = fields.get("warc-payload-digest")
                    row = (origin, _number(fields.get("warc-segment-number")) or 1, _number(fields.get("warc-segment-total-length")), fields.get("warc-type"), fields.get("warc-target-uri"), _name(fields.get("warc-refers-to")), digest and digest.removeprefix("sha1:"), block, None if whole else "truncated record")
                    held.append(row)
                    size += len(block)
                    if size > 1 << 22:
                        yield _batch(held, schema)
                        held, size = [], 0
                if held:
                    yield _batch(held, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, PART_SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _payload(block: bytes) -> bytes:
    head, end, body = block.partition(b"\r\n\r\n")
    if not end or not head.startswith(b"HTTP/"):
        raise FramingError("no HTTP head")
    coding = re.search(rb"(?im)^transfer-encoding:[ \t]*([^\r\n]*)", head)
    return dechunked(body) if coding and b"chunked" in coding[1].lower() else body


def _matches(digest: str, payload: bytes) -> bool:
    """Whether a SHA-1 in hexadecimal or base 32 is that of the payload."""
    made = hashlib.sha1(payload)
    return digest.lower() == made.hexdigest() or digest == base64.b32encode(made.digest()).decode()


def assemble(group: list[tuple]) -> Iterator[tuple]:
    """The records made of one origin's parts, given in the order of their numbers.

    Parts are tuples as in ``PART_SCHEMA``.  An origin that was written k times has each part k times.
    """
    first = group[0]
    by_number: dict[int, list[tuple]] = {}
    for part in group:
        by_number.setdefault(part[1], []).append(part)
    copies = len(by_number.get(1, ()))
    error = next((p[8] for p in group if p[8]), None)
    totals = {p[2] for p in group if p[2] is not None}
    length = sum(len(ps[0][7]) for ps in by_number.values())
    if error is None:
        if [*by_number] != [*range(1, len(by_number) + 1)]:
            error = "missing segment"
        elif any(len(ps) != copies or len({p[7] for p in ps}) > 1 for ps in by_number.values()):
            error = "segments that contradict each other"
        elif len(by_number) > 1 and totals != {length} or totals - {length}:
            error = "another total length"
    payload = None
    if error is None and first[3] == "response":
        try:
            payload = _payload(b"".join(ps[0][7] for ps in by_number.values()))
            if first[6] and not _matches(first[6], payload):
                payload, error = None, "another digest"
        except FramingError as e:
            error = str(e)
    for _ in range(max(1, copies)):
        yield (first[0], first[3], first[4], first[5], first[6], len(by_number), payload, error)


def reassembled(found: DataFrame) -> DataFrame:
    """Records from parts: those of an origin come to one task, in order, and one origin is held at a time."""
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("segments", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and part[0] != group[0][0]:
                    held += assemble(group)
                    size += sum(len(p[7]) for p in group)
                    group = []
                    if size > 1 << 22:
                        yield _batch(held, schema)
                        held, size = [], 0
                group.append(part)
        if group:
            held += assemble(group)
        if held:
            yield _batch(held, schema)

    return found.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(run, RECORD_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, uri, refers_to, digest, segments, payload, error) of every whole record under ``path``."""
    return reassembled(parts(spark, path))

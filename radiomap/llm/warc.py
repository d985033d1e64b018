"""WARC archives in Zstandard: a writer, and a reader that checks what it reads.

An archive begins with a skippable frame that holds the dictionary, and has
one frame for each record after it. Pages with the payload of another page are
written as revisits of the one with the smallest id. The dictionary is trained on
a bounded sample of pages (``DICTIONARY_PAGES``, ``DICTIONARY_PIECE``); it only
serves compression.

Archives are rows (archive, content), each of about ``ARCHIVE_BYTES``, so that
Spark writes and reads them in whatever store the tables are kept; ``load`` reads
archive files of a folder into the same form.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiomap.session import materialize

ARCHIVE_BYTES = 4 << 20
READ_BYTES = 8 << 20
DICTIONARY_PAGES, DICTIONARY_PIECE, DICTIONARY_BYTES = 500, 4_096, 32_768
LEAST_REVISITED = 100
DATE = "2000-01-01T00:00:00Z"
#: The magic numbers of a dictionary's skippable frame and of a Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
_SKIPPABLE = range(0x184D2A50, 0x184D2A60)
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
LEVEL = 3


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        head += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for pages like these; too few or too even a sample gives its
    own bytes as the dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def leading_frame(dictionary: bytes) -> bytes:
    data = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


def _payload_column() -> F.Column:
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def _kinds(pages: DataFrame) -> DataFrame:
    """``pages`` with payload, digest and the page that a row revisits (or null).

    Payloads stay where they are until the last join, by page, which no payload
    makes uneven."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         _payload_column().alias("payload"))
    slim = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("n")).where(
        (F.col("n") >= LEAST_REVISITED) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = slim.join(first.select("digest", "first"), "digest").where("page_id > first").select("page_id", "digest", "first")
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    return pages.join(again.distinct(), ["page_id", "digest"], "left")


def write(pages: DataFrame) -> DataFrame:
    """Archives (archive, content) of ``pages`` (page_id, url, html).

    Null html is an empty payload, a null url no header. Rows that repeat a page
    are records of their own; of equal payloads those with the smallest id are
    responses. A row without id is a response that nothing revisits. An empty
    table gives no archive."""
    full = pages.where(F.length(_payload_column()) > 0)
    share = min(1.0, DICTIONARY_PAGES / max(full.count(), 1))
    drawn = full.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = [bytes(r[0]) for r in drawn.select(F.substring(_payload_column(), 1, DICTIONARY_PIECE)).limit(2 * DICTIONARY_PAGES).collect()]
    shared = pages.sparkSession.sparkContext.broadcast(train_dictionary(sample) or b"WARC/1.1\r\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value), write_checksum=True)
        lead = leading_frame(shared.value)
        held, size = [lead], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{number:06d}.warc.zst"]), pa.array([b"".join(held)], pa.binary())],
                                              ["archive", "content"])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                held.append(squeeze.compress(record(*row)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size, number = [lead], 0, number + 1
        if size:
            yield archive()

    return _kinds(pages).select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "archive string, content binary")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The archive files (``*.warc.zst``) of a folder as rows (archive, content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("archive"), "content")


def frame_length(data: memoryview) -> int:
    """The length of the frame at the front, from its headers alone."""
    size = zstandard.frame_header_size(data)
    checksum = zstandard.get_frame_parameters(data).has_checksum
    while True:
        if size + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[size:size + 3], "little")
        size += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    size += 4 * checksum
    if size > len(data):
        raise ValueError("a frame is cut off")
    return size


def records(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    data, at = memoryview(content), 0
    dictionary = None
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("a frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in _SKIPPABLE:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC:
                raw = bytes(data[8:8 + size])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                dictionary = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame begins at byte {at}")
        size = frame_length(data[at:])
        one = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        opened = one.decompressobj()
        out = opened.decompress(data[at:at + size])
        if not opened.eof or opened.unused_data:
            raise ValueError(f"the frame at byte {at} does not end where its headers say")
        yield out
        at += size


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of one record, checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name) or name.lower() in fields:
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    size = fields["content-length"]
    if not re.fullmatch(r"[0-9]+", size) or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as its header says")
    return fields, rest[:-4]


def page_row(data: bytes) -> tuple:
    """(page_id, url, payload or None, payload_bytes, payload_digest, record_type, refers_to)."""
    fields, block = parse(data)
    number = lambda v: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", v or "")) else None
    head, found, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?mi)^content-length: ([0-9]+)\r?$", head)
    if not found or not length:
        raise ValueError("the block is no HTTP response with a length")
    size, kind = int(length[1]), fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its length or digest")
    if kind == "revisit" and (payload or number(fields.get("warc-refers-to")) is None):
        raise ValueError("a revisit has a payload, or refers to nothing")
    return (number(fields["warc-record-id"]), fields.get("warc-target-uri"), payload if kind == "response" else None,
            size, digest, kind, number(fields.get("warc-refers-to")))


_ROWS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame) -> DataFrame:
    """One row for each record: (page_id, url, payload, payload_bytes,
    payload_digest, record_type, refers_to); a revisit has no payload.

    Records leave an archive as they are decoded, ``READ_BYTES`` of them at a time.
    Anything that is not as the headers say fails the job, naming the archive."""
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                try:
                    for r in records(content):
                        rows.append(page_row(r))
                        held += len(r)
                        if held >= READ_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    raise ValueError(f"{name}: {e}") from e
                if rows:
                    yield batch(rows)

    return archives.select("archive", "content").mapInArrow(run, _ROWS)


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages' records, written to archives in the shared folder and read back."""
    return read(materialize(write(pages), "warc"))

"""Archives: round trips through rows and real files, and what the reader refuses."""

import hashlib

import pytest
import zstandard

from radiomap.llm import warc

SCHEMA = "page_id long, url string, html string, content string"


@pytest.fixture(scope="module")
def rows():
    big = "<p>é " * 200_000
    return [(5, "http://a/\r\nb", "x" * 100, "c"), (2, "u", "x" * 100, "c"), (9, None, "x" * 100, "c"), (9, None, "x" * 100, "c"),
            (3, "u", "x" * 99, "c"), (4, "u", "x" * 99, "c"), (6, "u", None, "c"), (7, "u", "", "c"), (None, "u", "x" * 100, "c"),
            (8, "u", big, "c"), (1, "u", big, "c")] + [(100 + k, "u", f"<html>{k} page body</html>" * 9, "c") for k in range(300)]


def want(rows):
    out = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        first = min((j for j, _, g, _ in rows if j is not None and (g or "") == (h or "")), default=None)
        again = len(p) >= 100 and i is not None and i > first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    archives = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(archives) > 3
    for a in archives:
        (tmp_path / a.archive).write_bytes(a.content)
    back = warc.read(warc.load(spark, str(tmp_path))).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str)
    assert got == want(rows)
    assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in back)


def test_an_archive_is_read_in_parts(spark, rows, monkeypatch):
    """One large archive gives the same rows however many of them are held at a time."""
    archives = warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    whole = sorted(map(str, warc.read(archives).collect()))
    monkeypatch.setattr(warc, "READ_BYTES", 300)
    assert sorted(map(str, warc.read(archives).collect())) == whole and len(whole) == len(rows)


def test_query_form_and_empty(spark, rows):
    assert warc.round_trip(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(*records, dictionary=b"WARC dictionary bytes"):
    squeeze = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return warc.leading_frame(dictionary) + b"".join(squeeze.compress(r) for r in records)


def test_reader_refuses():
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    data = archive(good, good)
    assert [warc.page_row(r)[0] for r in warc.records(data)] == [1, 1]
    stream = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    assert [warc.page_row(r)[0] for r in warc.records(stream.compress(good) + stream.flush())] == [1]
    for bad in (data[:-3], data + b"rest", b"\0" + data, data[:10]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.records(bad))
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: ", b"Content-Length: 1", 1),
                good.replace(b"payload\r\n\r\n", b"paylaod\r\n\r\n"), good.replace(b"WARC-Type", b"WARC Type"),
                good.replace(b"WARC-Date: ", b"X-Date: ")):
        with pytest.raises(ValueError, match="."):
            warc.page_row(bad)

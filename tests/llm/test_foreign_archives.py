"""Archives from elsewhere: spaces in fields, compressed members, records of other types, long payloads, clashing names."""

import base64
import gzip
import hashlib

import pytest

from impressa.llm import warc

BODY = b"HTTP/1.0 200 OK\r\nX-Page-Id: 5\r\n\r\nhello"
HEAD = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"


def archive(*lines):
    first = f"filedesc://a.arc 0.0.0.0 20240101000000 text/plain {len(HEAD)}\n".encode() + HEAD
    return [first, *((x + f" {len(BODY)}\n").encode() + BODY + b"\n" for x in lines)]


@pytest.mark.parametrize("packed", ["plain", "one member", "member a record", "cut"])
def test_arc(spark, packed):
    parts = archive("http://a/b c d 1.2.3.4 20240102030405 text/html", "http://a/ 1.2.3.4 20240102030405 text/html; charset=x", "http://a/20200101000000 1.2.3.4 20240102030406 no-type", "http://a/x 1.2.3.4 2024 text/html")
    content = {"plain": b"".join(parts), "one member": gzip.compress(b"".join(parts)), "member a record": b"".join(map(gzip.compress, parts)), "cut": b"".join(map(gzip.compress, parts)) + gzip.compress(b"http://a/z")[:-9]}[packed]
    got = warc.arc_to_records(spark.createDataFrame([("a", content, 1)], "name string, content binary, page_id int")).where("error is null").collect()
    assert [(r.url, r.ip, r.date, r.mime, r.page_id, bytes(r.payload)) for r in got] == [
        ("http://a/b c d", "1.2.3.4", "2024-01-02T03:04:05Z", "text/html", 5, b"hello"), ("http://a/", "1.2.3.4", "2024-01-02T03:04:05Z", "text/html; charset=x", 5, b"hello"),
        ("http://a/20200101000000", "1.2.3.4", "2024-01-02T03:04:06Z", "no-type", 5, b"hello"), ("http://a/x", "1.2.3.4", "1970-01-01T00:00:00Z", "text/html", 5, b"hello")]


def test_arc_of_version_2_with_spaces(spark):
    head = b"2 0 x\n"
    first = f"filedesc://a 0.0.0.0 20240101000000 text/plain 200 - - 0 a.arc {len(head)}\n".encode() + head
    one = f"http://a/b c 1.2.3.4 20240102030405 text/html; x 200 - - 77 a.arc {len(BODY)}\n".encode() + BODY + b"\n"
    got = warc.arc_to_records(spark.createDataFrame([("a", first + one)], "name string, content binary")).first()
    assert (got.url, got.ip, got.mime, got.error) == ("http://a/b c", "1.2.3.4", "text/html; x", None)


def test_warc_from_elsewhere(spark, tmp_path):
    digest = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    records = [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:1>\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a\r\n /b\r\nContent-Length: %d\r\n\r\n" % len(BODY) + BODY + b"\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (digest.encode(), len(BODY)) + BODY + b"\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = sorted(((r.record_type, r.page_id, r.payload_bytes, r.url, r.digest_ok) for r in warc.read_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == [("response", 5, 5, "http://a /b", None), ("response", 5, 5, None, True), ("revisit", None, None, None, None), ("warcinfo", None, 9, None, None)]


def test_long_payloads_and_clashing_columns(spark):
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://a/{i} x", "é" * 3_000_000 if i < 2 else None, "d", "r") for i in range(4)], "page_id long, url string, html string, digest string, record_type string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [(0, 6_000_000, "revisit", 1), (1, 6_000_000, "response", None), (2, 0, "revisit", 3), (3, 0, "response", None)]

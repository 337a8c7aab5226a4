"""Every record with a whole payload is converted, whatever its encoding, date or neighbours."""

import base64
import hashlib

from impressa.llm import warc


def record(page, payload, date="20240101000000", note=b""):
    document = b"HTTP/1.1 200 OK\r\nX-Note: %s\r\nX-Page-Id: %d\r\n\r\n" % (note, page) + payload
    return f"http://x/{page} 1.1.1.1 {date} text/html {len(document)}\n".encode() + document + b"\n"


def test_no_whole_record_is_lost(spark, tmp_path):
    latin, sjis, binary = "caf\u00e9".encode("latin-1"), "\u65e5\u672c".encode("shift_jis"), bytes(range(256)) * 3
    payloads = {1: latin, 2: sjis, 3: binary, 4: b"dated", 5: b"after a bad line", 6: b"after a bad length", 7: latin}
    head = b"filedesc://a 0.0.0.0 20240101000000 text/plain 4\n1 0\n"
    one = head + record(1, latin, note=b"\xe9") + record(2, sjis) + record(3, binary) + record(4, b"dated", "not-a-date")
    two = head + b"http://x/broken 1.1.1.1\nlost\n" + record(5, payloads[5]) + b"http://x/long 1.1.1.1 20240101000000 text/html 99999\nlost\n" + record(6, payloads[6]) + record(7, latin)
    archives = spark.createDataFrame([("one", bytearray(one)), ("two", bytearray(two))], "name string, content binary")
    assert [x[5] for x in warc.parse_arc(two)] == ["bad header line", None, "cut short", None, None]
    warc.write_warc(warc.warc_records(archives), f"{tmp_path}/w")
    got = {x.page_id: x for x in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert {i: (x.payload_bytes, x.payload_digest) for i, x in got.items()} == {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()) for i, p in payloads.items()}
    assert all(x.digest_ok for x in got.values()) and got[4].date == "1970-01-01T00:00:00Z"
    assert (got[1].record_type, got[1].refers_to, got[7].record_type) == ("revisit", 7, "response")
    raw = spark.read.format("binaryFile").load(f"{tmp_path}/w/*.gz").collect()
    assert any(b"X-Note: \xe9\r\n" in block for f in raw for _, block in warc.parse_warc(f.content))

"""WARC: converter from legacy ARC archives.

ARC version 1 lines are ``url ip date type length``; version 2 lines are
``url ip date type result checksum location offset filename length``.  The
version block that opens an archive says which one holds.  Records are taken by
their declared lengths.  Each becomes a WARC/1.1 record with a name-based
identifier, an ISO timestamp, an HTTP content type and a base32 SHA-1 payload
digest; of equal payloads one is a response and the others revisit it.

Payloads and HTTP headers are carried as bytes, so a payload in any encoding is
converted.  A bad date becomes 1970-01-01.  After a bad header line or a length
beyond the archive, parsing goes on at the next line that is a header with a
whole record behind it.

Archives are written by Spark's text sink (which writes the bytes of a string as
they are) with the record separator as line separator, so retries and lost executors cannot leave half files, and read back
as whole files of bounded record count.

Archives may be gzip, of one or many members.  Url and type fields with spaces
are told apart by the date.  A payload of any length is one record and one task's
memory.  Further columns, whatever their names, are not read.

A null or empty payload is a record of length 0; null urls become ``-``; pages
that repeat an id and payload are all responses or all revisits; records cut
short and bad header lines are returned with ``error`` set and not converted; an empty table gives
no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.llm.shared import cut, shared_dir, small_batches, trimmed

CRLF = "\r\n"
SEPARATOR = CRLF + CRLF
ARC_BYTES = 4_000_000
RECORDS_PER_FILE = 2_000
_V1 = b"URL IP-address Archive-date Content-type Archive-length\n"
_V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
_RECORD = "page_id long, url string, ip string, date string, mime string, http binary, payload binary, payload_bytes long, digest string, record_id string, error string"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _number(text: str | None) -> int | None:
    """A page number, or null for what archives from elsewhere may say there."""
    return int(text) if re.fullmatch(r"\s*-?\d{1,18}\s*", text or "", re.ASCII) else None


def _quote(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "-"


class ArcWriter:
    """One ARC archive in memory, of version 1 or 2."""

    def __init__(self, name: str, version: int, date: str = "20240101000000"):
        self.name, self.version, self.date = name, version, date
        body = b"%d 0 impressa\n%s\n" % (version, _V1 if version == 1 else _V2)
        self.parts, self.size = [self._line(f"filedesc://{name}", "0.0.0.0", "text/plain", len(body), 200, "-", 0) + body], 0

    def _line(self, url, ip, mime, length, code, checksum, offset) -> bytes:
        if self.version == 1:
            return f"{url} {ip} {self.date} {mime} {length}\n".encode()
        return f"{url} {ip} {self.date} {mime} {code} {checksum} - {offset} {self.name} {length}\n".encode()

    def add(self, url, ip, mime, document: bytes):
        self.parts += [self._line(url, ip, mime, len(document), 200, hashlib.md5(document).hexdigest(), self.size), document, b"\n"]
        self.size += len(document)

    def bytes(self) -> bytes:
        return b"".join(self.parts)


def arc_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARC_BYTES) -> DataFrame:
    """(name, content): ARC archives of the pages, of both versions in turn, within a task's batches."""

    @trimmed
    def run(batches):
        part = n = TaskContext.get().partitionId()
        for batch in batches:
            arc = None
            for i, u, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if arc is None:
                    arc = ArcWriter(f"pages-{part}-{n}.arc", 1 + n % 2)
                    n += 1
                document = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: %s\r\n\r\n" % str("" if i is None else i).encode() + (h or "").encode()
                arc.add(_quote(u), "127.0.0.1", "text/html", document)
                if arc.size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([arc.name]), pa.array([arc.bytes()])], ["name", "content"])
                    arc = None
            if arc is not None:
                yield pa.RecordBatch.from_arrays([pa.array([arc.name]), pa.array([arc.bytes()])], ["name", "content"])

    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "name string, content binary")


def _plain(content: bytes) -> bytes:
    """The content of gzip members, one after the other, or what is not compressed as it is; a broken last member as far as it goes."""
    out = []
    while content[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(content))
        except zlib.error:
            break
        content = d.unused_data
    return b"".join(out) if out else content


def _header(content: bytes, at: int, fields: int):
    """((url, ip, date, mime), first byte of the document, its declared size, spaces beyond the fields') of the line at a position, or None.

    Urls and media types may hold spaces: the date is the last field of 14
    digits that leaves room for the fields after it, or else counted from the right.
    """
    end = content.find(b"\n", at)
    if end < 0:
        return None
    line = content[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
    if len(line) < fields or not line[-1].isdecimal():
        return None
    last = len(line) - fields + 2  # of the date, if the type is one word
    date = next((i for i in range(last, 1, -1) if re.fullmatch(r"[0-9]{14}", line[i], re.ASCII)), last)
    return (" ".join(line[: date - 1]), line[date - 1], line[date], " ".join(line[date + 1 : len(line) - fields + 4])), end + 1, int(line[-1])


def _resync(content: bytes, at: int, fields: int) -> int:
    """The next line after a position that is a header of a url with a whole record behind it, or the end."""
    while (at := content.find(b"\n", at) + 1) > 0:
        found = _header(content, at, fields)
        if found and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", found[0][0]):
            after = found[1] + found[2]
            if after == len(content) or content[after : after + 1] == b"\n":
                return at
    return len(content)


def parse_arc(content: bytes):
    """(url, ip, date, mime, document, error) of each record after the version block, of a plain or a compressed archive."""
    content = _plain(content)
    at = content.find(b"\n") + 1
    head = content[: at - 1].split(b" ")
    try:
        length = int(head[-1])
        version = int(content[at : at + length].split(b" ", 1)[0])
    except (ValueError, IndexError):
        yield "-", "-", "-", "-", b"", "no version block"
        return
    at += length
    fields = 5 if version == 1 else 10
    while at < len(content):
        if content[at : at + 1] == b"\n":
            at += 1
            continue
        found = _header(content, at, fields)
        if found is None:
            yield "-", "-", "-", "-", b"", "bad header line"
            at = _resync(content, at, fields)
            continue
        line, start, size = found
        document = content[start : start + size]
        if len(document) < size:
            yield *line, document, "cut short"
            at = _resync(content, at, fields)
            continue
        yield *line, document, None
        at = start + size


def arc_to_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ARC archives (name, content) with synthesised identifiers, timestamps and digests.

    HTTP headers and payloads are bytes as they stand in the archive.
    """

    @trimmed
    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for url, ip, date, mime, document, error in parse_arc(content.as_py()):
                    head, blank, payload = document.partition(b"\r\n\r\n")
                    if not document.startswith(b"HTTP/") or not blank:
                        head, payload = b"HTTP/1.0 200 OK", document
                    page = None
                    for line in head.decode("latin-1").split(CRLF)[1:]:
                        if line.lower().startswith("x-page-id:"):
                            page = _number(line[10:])
                    try:
                        when = datetime.strptime(date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
                    except ValueError:
                        when = "1970-01-01T00:00:00Z"
                    digest = _digest(payload)
                    rows.append((page, url, ip, when, mime, head, payload if payloads else None, len(payload), digest, uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {page} {digest}").urn, error))
                    if len(rows) == 500:
                        yield _records(rows)
                        rows = []
                yield _records(rows)

    return archives.select("name", "content").mapInArrow(run, _RECORD)


def _records(rows):
    cols = list(zip(*rows, strict=True)) or [[]] * 11
    kinds = [pa.int64(), *[pa.string()] * 4, *[pa.binary()] * 2, pa.int64(), *[pa.string()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _RECORD.split(", ")])


def warc_records(archives: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """WARC records (page_id, record as bytes) of ARC archives.

    Of records with equal payloads of at least min_revisit_bytes, that with the
    largest page_id is the response.  Digests are grouped first (a row per
    digest and task is shuffled); payloads move once, by page.
    """
    keys = cut(arc_to_records(archives, payloads=False).where("error is null and page_id is not null").select("page_id", "digest", "payload_bytes", "record_id", "date", "url"))
    chosen = keys.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("digest", "payload_bytes").agg(F.max_by(F.struct("page_id", "record_id", "date", "url"), F.struct("page_id", "record_id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    records = arc_to_records(archives).where("error is null")
    known = chosen.select(F.col("digest").alias("_d"), F.col("payload_bytes").alias("_n"), "first")
    # digests with copies are few rows, but one may hold a third of the pages: revisits are decided on narrow rows
    again = keys.select("page_id", "digest", "payload_bytes", "record_id").join(known, (F.col("digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_n"))).where("page_id < first.page_id").select(F.col("record_id").alias("_id"), "first").distinct()
    rows = records.join(again, F.col("record_id") == F.col("_id"), "left")
    revisit = F.col("first").isNotNull()
    # a cast from binary to string keeps the bytes, UTF-8 or not
    http = F.concat(F.col("http").cast("string"), F.lit(SEPARATOR))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload").cast("string")))
    text = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: <"), "record_id", F.lit(">")),
        F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Target-URI: "), "url"), F.concat(F.lit("WARC-IP-Address: "), "ip"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(revisit, F.concat_ws(CRLF, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.concat(F.lit("WARC-Refers-To: <"), "first.record_id", F.lit(">")), F.concat(F.lit("WARC-Refers-To-Target-URI: "), "first.url"), F.concat(F.lit("WARC-Refers-To-Date: "), "first.date"), F.concat(F.lit("X-Refers-To-Page-Id: "), "first.page_id"))),
        F.concat(F.lit("X-Payload-Length: "), "payload_bytes"), F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block)), F.lit(CRLF))
    return rows.select("page_id", F.concat(text, block).cast("binary").alias("record"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip", records_per_file: int = RECORDS_PER_FILE) -> None:
    """WARC files of at most records_per_file records under path."""
    records.select(F.col("record").cast("string")).write.option("lineSep", SEPARATOR).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(content: bytes):
    """(headers, block) of each record of a WARC file, gzip or plain, by declared length."""
    content, at = _plain(content), 0
    while (at := content.find(b"WARC/", at)) >= 0:
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = re.sub(r"\r\n[ \t]+", " ", content[at:end].decode("utf-8", "replace")).split(CRLF)[1:]
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = _number(headers.get("content-length"))
        if size is None or size < 0:
            at = end
            continue
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to and headers.

    Sizes and digests of responses are computed from the payloads read; revisits
    have those their headers state.  Records of other types (warcinfo, request,
    metadata...) have the size and digest of their block.  What a header does
    not state is null, and so is ``digest_ok`` without a base32 SHA-1 to compare.
    """

    @trimmed
    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in parse_warc(content.as_py()):
                    kind = h.get("warc-type", "")
                    web = kind in ("response", "revisit") and block.startswith(b"HTTP/")
                    http, _, payload = block.partition(b"\r\n\r\n") if web else (b"", b"", block)
                    page = next((x[10:].strip() for x in http.decode("latin-1").split(CRLF) if x.lower().startswith("x-page-id:")), "")
                    stated = h.get("warc-payload-digest" if kind in ("response", "revisit") else "warc-block-digest")
                    stated = stated.removeprefix("sha1:") if stated and re.fullmatch(r"sha1:[A-Z2-7]{32}", stated) else None
                    digest = stated if kind == "revisit" else _digest(payload)
                    size = _number(h.get("x-payload-length")) if kind == "revisit" else len(payload)
                    rows.append((_number(page), size, digest, kind, _number(h.get("x-refers-to-page-id")), h.get("warc-record-id"), h.get("warc-date"), h.get("warc-target-uri"), None if stated is None else digest == stated))
                cols = list(zip(*rows, strict=True)) or [[]] * 9
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "url", "digest_ok"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, url string, digest_ok boolean")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to ARC, converted to WARC files in the shared folder, and read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(warc_records(arc_archives(pages, id_col, url_col, html_col)), path)
    return read_warc(spark, path)

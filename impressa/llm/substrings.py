"""Removal of byte strings that occur in an earlier document.

A byte goes if it lies in a ``LENGTH``-byte string that also starts in a
document with a smaller id.  Suffixes are handled by bucket, the bucket being
the rarest-hash ``K``-byte string (minimizer) of their first LENGTH bytes, so
equal suffixes meet in one bucket at equal places:

1. Every task sends 32 bits of each bucket key it holds; buckets with one
   document only are dropped (``sharing.frequency_levels``).
2. For the others each task sends the bytes around the key once per distinct
   context: of documents with equal contexts (compared byte by byte) the
   smallest is sent, the others are resolved at once.  A key in a third of all
   documents thus costs one row per task and context.  Contexts of a key with
   many documents are cut to lots (``lots``) that are dealt by the bytes that
   their windows have in common, so different contexts of it do not meet.
3. Reducers stream the bucket ranges.  In a range equal contexts become one
   class again; where a key has several classes, their suffixes are ordered by
   a difference cover (``suffixes``), and each run of neighbours with LENGTH
   bytes in common goes to its smallest document.
4. Removed runs are merged per document and joined with the texts concerned.

Matches never cross documents.
Null and empty texts and those under LENGTH bytes lose nothing; a null id is
never removed and removes nothing; rows that repeat a doc_id must repeat its
text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.shared import cut, fresh, keyed, trimmed
from impressa.llm.sharing import frequency_levels, id_bitmap, levels_of, maybe_in
from impressa.llm.suffixes import Suffixes, buckets
from impressa.llm.text import chunks, mix, powers, prefix_hash, range_hash, string_buffer

LENGTH = 50
K = 20
#: Documents that make a key shared, hot and very hot (with the bits of their bitmaps), and the windows of a lot of a hot key.
_SHARED = ((2, 27), (1024, 25), (65_536, 23))
_LOT = (0, 0, 8, 1)  # by level; 0: the key is not cut
_HELD = 100_000  # contexts


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a, size = best(a[:-size], a[size:]), size * 2
    rest = width - size
    return best(a[:-rest], a[rest:]) if rest else a


class Anchors:
    """Minimizers of all LENGTH-byte windows of a chunk: positions ``at`` and 64-bit ``key``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K):
        n, self.length, self.width = len(data), length, length - k + 1
        self.at, self.key = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n < length:
            return
        self.sums = prefix_hash(data)
        _, down = powers(n)
        h = mix((self.sums[k:] - self.sums[:-k]) * down[: n - k + 1])
        self.order = (h >> np.uint64(32)).astype(np.uint32)
        step = np.zeros(n - length + 2, np.int8)
        long = np.flatnonzero(np.diff(offsets) >= length)
        np.add.at(step, offsets[long], 1)
        np.add.at(step, offsets[long + 1] - length + 1, -1)
        self.valid = np.cumsum(step[:-1]) > 0
        self.least = _slide(self.order, self.width, np.minimum)
        most = np.zeros(len(self.least) + 2 * (self.width - 1), np.uint32)
        most[self.width - 1 : self.width - 1 + len(self.least)] = np.where(self.valid, self.least, 0)
        self.at = np.flatnonzero(_slide(most, self.width, np.maximum) == self.order)
        h = h[self.at]
        self.key = (h << np.uint64(32)) | (h >> np.uint64(32))  # the order's bits are small by choice

    def intervals(self, which: np.ndarray):
        """(anchors, first and last window start) of those of ``which`` that are the minimizer of some window."""
        at = self.at[which]
        first, last = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), -1)
        for shift in range(self.width):
            s = at - shift
            inside = np.clip(s, 0, len(self.valid) - 1)
            ok = (s == inside) & self.valid[inside] & (self.least[inside] == self.order[at])
            first[ok] = s[ok]
            last[ok] = np.maximum(last[ok], s[ok])
        some = last >= 0
        return which[some], first[some], last[some]


def lots(a: Anchors, which: np.ndarray, first: np.ndarray, last: np.ndarray, level: np.ndarray, k: int = K):
    """(anchors, first and last window start, key to deal by) of contexts, those of hot keys cut to lots.

    A window holds e bytes before its anchor.  Windows whose e fall in one lot
    have the bytes around the anchor in common that all of them hold, and are
    dealt by a hash of those: 43 of 50 bytes, or all if the key is very hot.
    """
    rest, at = a.length - k, a.at[which]
    size = np.array(_LOT)[level]
    least, most, step = at - last, at - first, np.maximum(size, 1)
    low = np.where(size > 0, least // step, 0)
    n = np.where(size > 0, most // step - low, 0) + 1
    own = np.repeat(np.arange(len(which)), n)
    lot = _places(low, n)
    cut, step = size[own] > 0, step[own]
    begin = np.where(cut, np.maximum(least[own], lot * step), least[own])
    end = np.where(cut, np.minimum(most[own], lot * step + step - 1), most[own])
    key = a.key[which][own]
    left, right = lot[cut] * step[cut], rest - np.minimum(lot[cut] * step[cut] + step[cut] - 1, rest)
    key[cut] = mix(range_hash(a.sums, at[own][cut] - left, at[own][cut] + k + right) + lot[cut].astype(np.uint64))
    return which[own], at[own] - end, at[own] - begin, key


def _chunks(batch, text):
    data, offsets = string_buffer(batch.column(text))
    for first, last in chunks(offsets):
        own = offsets[first : last + 1]
        yield first, data[own[0] : own[-1]], own - own[0]


def removed_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, starts, ends): the maximal removed byte runs of each document that loses bytes."""
    rows = keyed(docs, id_col, text_col).where("doc_id is not null")

    def keys_of(batch):
        for first, data, offsets in _chunks(batch, "text"):
            a = Anchors(data, offsets, length, k)
            yield np.searchsorted(offsets, a.at, "right") - 1 + first, a.key

    shared = frequency_levels(rows, keys_of, _SHARED)
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 16 * width

    @trimmed
    def send(batches):
        held, n = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, data, offsets in _chunks(batch, "text"):
                a = Anchors(data, offsets, length, k)
                if not len(a.at):
                    continue
                level = levels_of(shared.value, a.key)
                which, lo, hi = a.intervals(np.flatnonzero(level))
                if not len(which):
                    continue
                which, lo, hi, key = lots(a, which, lo, hi, level[which], k)
                size, doc = hi + length - lo, np.searchsorted(offsets, lo, "right") - 1
                held.append((range_hash(a.sums, lo, lo + size), key, ids[doc + first], lo - offsets[doc], size, a.at[which] - lo, data[_places(lo, size)]))
                n += len(which)
                if n >= _HELD:
                    yield from _contexts(held, parts)
                    held, n = [], 0
        if n:
            yield from _contexts(held, parts)

    sent = rows.mapInArrow(send, "part int, done boolean, docs binary, starts binary, sizes binary, anchors binary, body binary").repartition(width, "part").sortWithinPartitions("part")

    @trimmed
    def find(batches):
        out, n = [], 0
        for mine in _by_part(batches):
            for done, d, s, z, _, _ in mine:
                if done:
                    out.append((d, s, s + z))
            lot = [x[1:] for x in mine if not x[0]]
            if lot:
                out += _matches(*(np.concatenate(x) for x in zip(*lot, strict=True)), length, k)
            n += sum(len(x[1]) for x in mine)
            if n >= _HELD:
                yield from _by_document(out, width)
                out, n = [], 0
        yield from _by_document(out, width)

    found = sent.mapInArrow(find, "part int, docs binary, starts binary, ends binary").repartition(width, "part")

    @trimmed
    def merge(batches):
        groups = defaultdict(list)
        for batch in batches:
            for p, *blobs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                groups[p].append([np.frombuffer(b, np.int64 if i == 0 else np.int32) for i, b in enumerate(blobs)])
        for p in sorted(groups):
            d, s, e = (np.concatenate(x) for x in zip(*groups.pop(p), strict=True))
            yield _merged(d, s.astype(np.int64), e.astype(np.int64))

    return found.mapInArrow(merge, "doc_id long, starts array<int>, ends array<int>")


def _before(size: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(size)[:-1]))


def _places(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all bytes of the runs, one run after the other."""
    return np.repeat(at - _before(size), size) + np.arange(size.sum())


def _classes(body: np.ndarray, at: np.ndarray, size: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Class number of each byte run: equal numbers for equal bytes.  Found by hash, then compared byte by byte."""
    order = np.argsort(context)
    same = np.zeros(len(order), bool)
    same[1:] = (context[order][1:] == context[order][:-1]) & (size[order][1:] == size[order][:-1])
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    again = np.flatnonzero(same)
    z = size[order[again]]
    if len(again) and (body[_places(at[order[again]], z)] != body[_places(at[lead[again]], z)]).any():
        known: dict[bytes, int] = {}  # two texts with one hash
        return np.array([known.setdefault(body[p : p + n].tobytes(), len(known)) for p, n in zip(at, size, strict=True)])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~same) - 1
    return out


def _contexts(held, parts: int):
    """Rows to send: the smallest document of each distinct context; the others are done."""
    context, key, doc, start, size, anchor, body = (np.concatenate(x) for x in zip(*held, strict=True))
    at = _before(size)
    number = _classes(body, at, size, context)
    least = np.full(number.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc)
    later = doc > least[number]
    part = (key >> np.uint64(32)) % np.uint64(parts)
    for done in (False, True):
        which = np.flatnonzero(later == done)
        which = which[np.argsort(part[which], kind="stable")]
        for own in np.split(which, np.flatnonzero(np.diff(part[which].astype(np.int64))) + 1):
            if len(own):
                text = b"" if done else body[_places(at[own], size[own])].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[own[0]])], pa.int32()), pa.array([done]), *(pa.array([x[own].astype(t).tobytes()]) for x, t in ((doc, np.int64), (start, np.int32), (size, np.int16), (anchor, np.int16))), pa.array([text], pa.binary())],
                    ["part", "done", "docs", "starts", "sizes", "anchors", "body"])


def _by_part(batches):
    """Lists of (done, docs, starts, sizes, anchors, body), one for each bucket range; rows come sorted by it."""
    now, held = None, []
    for batch in batches:
        for p, done, *blobs in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if p != now and held:
                yield held
                held = []
            now = p
            d, s, z, a, body = (np.frombuffer(b, t) for b, t in zip(blobs, (np.int64, np.int32, np.int16, np.int16, np.uint8), strict=True))
            held.append((done, d, s.astype(np.int64), z.astype(np.int64), a.astype(np.int64), body))
    if held:
        yield held


def _matches(doc, start, size, anchor, body, length, k):
    """Matched runs (docs, starts, ends) of the contexts of one bucket range.

    Equal contexts are one class: documents after its first lose all of it.
    What is left to find are windows that differing contexts of one key share.
    """
    at, sums = _before(size), prefix_hash(body)
    number = _classes(body, at, size, range_hash(sums, at, at + size))
    order = np.lexsort((doc, number))
    first = np.flatnonzero(np.concatenate(([True], number[order][1:] != number[order][:-1])))
    lead = order[first]
    least = doc[lead]
    later = doc > least[number]
    out = [(doc[later], start[later], start[later] + size[later])]
    key = range_hash(sums, at[lead] + anchor[lead], at[lead] + anchor[lead] + k)
    _, bucket, n = np.unique(key, return_inverse=True, return_counts=True)
    several = np.flatnonzero(n[bucket] > 1)
    if not len(several):
        return out
    own, a, z = _smallest(least[several], size[lead[several]], body[_places(at[lead[several]], size[lead[several]])], length)
    begin, end = np.full(len(lead), -1), np.full(len(lead), -1)
    begin[several[own]], end[several[own]] = a, z
    rest = np.flatnonzero(~later & (begin[number] >= 0))
    return [*out, (doc[rest], start[rest] + begin[number[rest]], start[rest] + end[number[rest]])]


def _smallest(doc, size, body, length):
    """(context, start, end within it) of the windows that a context of a smaller document has too."""
    windows = size - length + 1
    which = np.repeat(np.arange(len(doc)), windows)
    place = _places(np.zeros(len(doc), np.int64), windows)
    at = _places(_before(size), windows)
    suffixes, hit = Suffixes(body, length), np.zeros(len(at), bool)
    for own in buckets(suffixes, at):
        order, same = suffixes.order(at[own])
        first = np.flatnonzero(~same)
        d = doc[which[own[order]]]
        least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(d))))
        hit[own[order]] = d > least
    on = np.flatnonzero(hit)
    # windows of one context all hold its key, so those that are hit overlap: they are one run
    owner, head = np.unique(which[on], return_index=True)
    tail = np.append(head[1:], len(on))[: len(head)] - 1
    return owner, place[on[head]], place[on[tail]] + length


def _by_document(out, parts):
    if not out:
        return
    d, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
    if not len(d):
        return
    part = (mix(d.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((s, d, part))
    d, s, e, part = d[order], s[order], e[order], part[order]
    for own in np.split(np.arange(len(d)), np.flatnonzero(np.diff(part)) + 1):
        a, b, c = _union(d[own], s[own], e[own])
        yield pa.RecordBatch.from_arrays([pa.array([int(part[own[0]])], pa.int32()), pa.array([a.tobytes()]), pa.array([b.astype(np.int32).tobytes()]), pa.array([c.astype(np.int32).tobytes()])], ["part", "docs", "starts", "ends"])


def _union(d, s, e):
    """Maximal runs of intervals sorted by document and start."""
    rank = np.cumsum(np.concatenate(([0], d[1:] != d[:-1])))
    reach = np.maximum.accumulate((rank << 32) + e)
    new = np.concatenate(([True], (rank[1:] << 32) + s[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return d[first], s[first], reach[last] - (rank[last] << 32)


def _merged(d, s, e):
    order = np.lexsort((s, d))
    d, s, e = _union(d[order], s[order], e[order])
    first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    offsets = pa.array(np.append(first, len(d)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(d[first]), pa.ListArray.from_arrays(offsets, pa.array(s, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(e, pa.int32()))], ["doc_id", "starts", "ends"])


def kept_bytes(raw: bytes, starts, ends) -> bytes:
    out, last = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(raw[last:s])
        last = e
    return b"".join([*out, raw[last:]])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Only texts that may lose bytes are shuffled; the others are hashed in place.
    """
    rows = keyed(docs, id_col, text_col)
    runs = cut(removed_runs(docs, id_col, text_col, length, k))
    known = id_bitmap(runs.select("doc_id"))

    @trimmed
    def place(batches):
        for batch in batches:
            ids, texts, size, sha, text = batch.column("doc_id"), batch.column("text"), [], [], []
            for at in range(0, batch.num_rows, 500):
                move = maybe_in(known.value, ids.slice(at, 500))
                for m, t in zip(move.tolist(), texts.slice(at, 500).to_pylist(), strict=True):
                    raw = (t or "").encode()
                    size.append(len(raw))
                    sha.append(None if m else hashlib.sha256(raw).hexdigest())
                    text.append(t or "" if m else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_bytes", "sha", "text"])

    spans = runs.select(F.col("doc_id").alias("_id"), "starts", "ends")
    both = rows.mapInArrow(place, "doc_id long, n_bytes long, sha string, text string").join(spans, F.col("doc_id") == F.col("_id"), "left").drop("_id")

    @trimmed
    def finish(batches):
        for batch in batches:
            removed, n, sha = [], [], []
            for s, t, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "starts", "ends")), strict=True):
                starts, ends = starts or [], ends or []
                removed.append(sum(ends) - sum(starts))
                n.append(len(starts))
                sha.append(s if s is not None else hashlib.sha256(kept_bytes(t.encode(), starts, ends)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """All documents with the removed runs cut out of their text; a character cut in two goes whole."""
    runs = cut(removed_runs(docs, id_col, text_col, length, k))
    known = id_bitmap(runs.select("doc_id"))
    ids = docs.schema.fieldNames().index(id_col)

    def part(concerned):
        @trimmed
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(maybe_in(known.value, batch.column(ids).cast(pa.int64())) == concerned))

        return docs.mapInArrow(run, docs.schema)

    key, first, last = (fresh(c, docs) for c in ("_key", "_starts", "_ends"))
    spans = runs.select(F.col("doc_id").alias(key), F.col("starts").alias(first), F.col("ends").alias(last))
    both = part(True).join(spans, F.col(id_col).cast("long") == F.col(key), "left").drop(key)

    @trimmed
    def clean(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = []
            for t, starts, ends in zip(*(batch.column(c).to_pylist() for c in (text_col, first, last)), strict=True):
                texts.append(t if not starts else kept_bytes(t.encode(), starts, ends).decode("utf-8", "ignore"))
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).select(list(range(batch.num_columns - 2)))

    return part(False).unionByName(both.mapInArrow(clean, docs.schema))

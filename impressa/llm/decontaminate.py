"""Benchmark decontamination by a broadcast hash set of normalised word windows.

Text is normalised by lower-casing A-Z and taking runs of digits, letters and
characters beyond ASCII as words.  Every run of ``n`` words of a benchmark item
is a window (a shorter item is one window).  Documents are scanned in Arrow
batches: window hashes are looked up in the broadcast set, hits are verified
word by word, and every word of an occurrence counts as hit.

The set is broadcast only if it has at most ``max_broadcast`` windows, counted
first; beyond that the windows of the documents are joined with those of the
benchmark by a shuffle on the hash.

Null or empty texts have no words and no hits; items without words have no
windows; repeated items each count; an empty benchmark leaves all documents
clean; a null identifier is kept as it is, and counts as one item; rows that
repeat a doc_id are rows of their own; a very long text is a chunk of its own;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.shared import fresh, keyed, small_batches, trimmed
from impressa.llm.sharing import id_bitmap, maybe_in
from impressa.llm.text import ALNUM, documents_of, run_hash

WINDOW = 13
MAX_BROADCAST = 500_000
_SCAN = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>"
_BITS = 20


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """(hash, n, words, item_id), one row per distinct window of an item."""

    @trimmed
    def run(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), set()
            for first, _, w in documents_of(batch, "text", ALNUM):
                h, text = w.hash, w.data.tobytes()
                for d in np.flatnonzero(w.count):
                    size = min(n, int(w.count[d]))
                    at = np.arange(w.first[d], w.first[d + 1] - size + 1)
                    for i, key in zip(at, run_hash(h, at, size).view(np.int64).tolist(), strict=True):
                        rows.add((key, size, b" ".join(text[s:e] for s, e in zip(w.start[i : i + size], w.end[i : i + size], strict=True)), ids[first + d]))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["hash", "n", "words", "item_id"])

    return keyed(benchmark, id_col, text_col).mapInArrow(run, "hash long, n int, words binary, item_id long").distinct()


def _window_set(rows):
    """What is broadcast, in plain arrays and dicts: sorted hashes and a bit table by window length, and the items of each window."""
    items: dict[bytes, list[int]] = {}
    by_size: dict[int, set[int]] = {}
    for r in rows:
        items.setdefault(bytes(r.words), []).append(r.item_id)
        by_size.setdefault(r.n, set()).add(r.hash & 0xFFFFFFFFFFFFFFFF)
    hashes = {k: np.array(sorted(v), np.uint64) for k, v in by_size.items()}
    bits = {k: np.zeros(1 << _BITS, bool) for k in hashes}
    for k, v in hashes.items():
        bits[k][(v >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return items, hashes, bits


def _find(known, w):
    """(first word, length, item ids) of each verified occurrence in a chunk."""
    items, hashes, bits = known
    h, raw = w.hash, None
    for size, own in hashes.items():
        first, keys = w.windows(size, h)
        maybe = np.flatnonzero(bits[size][(keys >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(own, keys[maybe]), len(own) - 1)
        for i in first[maybe[own[at] == keys[maybe]]].tolist():
            raw = w.data.tobytes() if raw is None else raw
            words = b" ".join(raw[s:e] for s, e in zip(w.start[i : i + size], w.end[i : i + size], strict=True))
            if words in items:
                yield i, size, items[words]


def _scan_chunk(w, known):
    """Hit words, items and byte spans of each document of a chunk."""
    step, items = np.zeros(len(w.start) + 1, np.int64), defaultdict(set)
    for i, size, found in _find(known, w):
        step[i] += 1
        step[i + size] -= 1
        items[int(w.doc[i])].update(found)
    hit = np.cumsum(step[:-1]) > 0
    n_hit = np.bincount(w.doc[hit], minlength=w.n_docs)
    spans = defaultdict(list)
    for d in items:
        own = np.arange(w.first[d], w.first[d + 1])
        on = np.concatenate(([False], hit[own], [False]))
        for a, b in zip(np.flatnonzero(~on[:-1] & on[1:]), np.flatnonzero(on[:-1] & ~on[1:]), strict=True):
            spans[d].append({"start": int(w.start[own[a]] - w.offsets[d]), "end": int(w.end[own[b - 1]] - w.offsets[d])})
    return n_hit, items, spans


def _broadcast_set(windows: DataFrame, max_broadcast: int):
    """The broadcast set, or None if it would pass the bound."""
    windows = windows.cache()
    try:
        if windows.count() > max_broadcast:
            return None
        return windows.sparkSession.sparkContext.broadcast(_window_set(windows.collect()))
    finally:
        windows.unpersist()


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids) and the byte spans of the hit runs."""
    windows = benchmark_windows(benchmark, n=n)
    known = _broadcast_set(windows, max_broadcast)
    if known is None:
        return _scan_by_join(docs, windows, id_col, text_col).drop("t")

    @trimmed
    def run(batches):
        for batch in batches:
            words, hits, items, spans = [], [], [], []
            for _, _, w in documents_of(batch, "text", ALNUM):
                n_hit, found, runs = _scan_chunk(w, known.value)
                words += w.count.tolist()
                hits += n_hit.tolist()
                items += [sorted(found.get(d, ()), key=lambda x: (x is None, x)) for d in range(w.n_docs)]
                spans += [runs.get(d, []) for d in range(w.n_docs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return keyed(docs, id_col, text_col).mapInArrow(run, _SCAN)


def _scan_by_join(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same rows where the benchmark is too large to broadcast: a shuffle join on the window."""
    sizes = [r.n for r in windows.select("n").distinct().collect()]
    maybe = id_bitmap(windows.select("hash"))

    @trimmed
    def explode(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("t")
            for first, _, w in documents_of(batch, "text", ALNUM):
                h, raw = w.hash, w.data.tobytes()
                for size in sizes:
                    at, keys = w.windows(size, h)
                    some = maybe_in(maybe.value, pa.array(keys.view(np.int64)))
                    at, keys = at[some], keys[some]
                    for lo in range(0, len(at), 50_000):
                        part = at[lo : lo + 50_000]
                        d = w.doc[part]
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(d + first)), texts.take(pa.array(d + first)), pa.array(keys[lo : lo + 50_000].view(np.int64)), pa.array([b" ".join(raw[s:e] for s, e in zip(w.start[i : i + size], w.end[i : i + size], strict=True)) for i in part], pa.binary()), pa.array(part - w.first[d]), pa.array(np.full(len(part), size)), pa.array(w.start[part] - w.offsets[d]), pa.array(w.end[part + size - 1] - w.offsets[d])],
                            ["doc_id", "t", "hash", "words", "at", "size", "start", "end"],
                        )

    @trimmed
    def count(batches):
        for batch in batches:
            n = [w.count for _, _, w in documents_of(batch, "text", ALNUM)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(np.concatenate(n) if n else [], pa.int64())], ["doc_id", "t", "n_words"])

    # documents without an identifier are told apart by their texts
    rows = keyed(docs, id_col, text_col).withColumn("t", F.xxhash64("text"))
    hits = rows.mapInArrow(explode, "doc_id long, t long, hash long, words binary, at long, size long, start long, end long").join(windows.drop("n"), ["hash", "words"])
    word_spans = hits.select("doc_id", "t", "item_id", "at", "size", "start", "end")
    merged = word_spans.groupBy("doc_id", "t").agg(F.transform(F.array_sort(F.collect_set(F.struct("item_id"))), lambda x: x["item_id"]).alias("items"), F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("to"), "start", "end"))).alias("runs"))
    start = "cast(array() as array<struct<at:bigint,to:bigint,start:bigint,end:bigint>>)"
    fold = f"""aggregate(runs, {start}, (a, r) -> case when size(a) > 0 and a[size(a) - 1].to >= r.at
        then concat(slice(a, 1, size(a) - 1), array(named_struct('at', a[size(a) - 1].at, 'to', greatest(a[size(a) - 1].to, r.to), 'start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, r.end))))
        else concat(a, array(r)) end)"""
    merged = merged.withColumn("runs", F.expr(fold)).select(
        F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "items", F.expr("aggregate(runs, 0L, (n, r) -> n + r.to - r.at)").alias("n_hit"), F.expr("transform(runs, r -> named_struct('start', r.start, 'end', r.end))").alias("spans"))
    none = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return (rows.mapInArrow(count, "doc_id long, t long, n_words long").join(merged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
            .select("doc_id", "t", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans")))


def contaminated(share: int = 20):
    """A document is contaminated if at least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, share: int = 20, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The clean documents with all their columns, without a shuffle of the texts."""
    windows = benchmark_windows(benchmark, n=n)
    known = _broadcast_set(windows, max_broadcast)
    if known is None:
        key, text = fresh("_id", docs), fresh("_t", docs)
        bad = _scan_by_join(docs, windows, id_col, text_col).where(contaminated(share)).select(F.col("doc_id").alias(key), F.col("t").alias(text)).distinct()
        return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(text)), "left_anti")

    @trimmed
    def run(batches):
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for _, _, w in documents_of(batch, text_col, ALNUM):
                n_hit = _scan_chunk(w, known.value)[0]
                keep.append(~((n_hit > 0) & (share * n_hit >= w.count)))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return small_batches(docs).mapInArrow(run, docs.schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """All documents, with the hit runs cut out of the text."""
    windows = benchmark_windows(benchmark, n=n)
    known = _broadcast_set(windows, max_broadcast)
    at = docs.schema.fieldNames().index(text_col)

    def with_texts(batch, texts):
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    if known is None:
        key, text, runs = fresh("_id", docs), fresh("_t", docs), fresh("_spans", docs)
        found = _scan_by_join(docs, windows, id_col, text_col).where("n_hit > 0").select(F.col("doc_id").alias(key), F.col("t").alias(text), F.col("spans").alias(runs)).distinct()
        both = small_batches(docs).join(found, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(text)), "left").drop(key, text)

        @trimmed
        def clean(batches):
            for batch in batches:
                texts = [_without(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(runs).to_pylist(), strict=True)]
                yield with_texts(batch.select(list(range(batch.num_columns - 1))), texts)

        return both.mapInArrow(clean, docs.schema)

    @trimmed
    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for first, _, w in documents_of(batch, text_col, ALNUM):
                for d, spans in _scan_chunk(w, known.value)[2].items():
                    texts[first + d] = _without(texts[first + d], spans)
            yield with_texts(batch, texts)

    return small_batches(docs).mapInArrow(run, docs.schema)


def _without(text: str | None, spans) -> str | None:
    """The text without the byte spans."""
    if not spans:
        return text
    raw, last, out = text.encode(), 0, []
    for s in spans:
        out.append(raw[last : s["start"]])
        last = s["end"]
    return b"".join([*out, raw[last:]]).decode()

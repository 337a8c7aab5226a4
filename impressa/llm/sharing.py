"""Which keys do documents share?  Document-frequency levels in fixed-size bitmaps.

Every task sends 32 bits of each distinct key once, packed by range; reducers
add up the document frequencies of their range and return, for each threshold,
a slice of a bitmap.  The bitmaps are broadcast: their size is set by
``THRESHOLDS`` and not by the data.  Keys that fall on one bit count together,
so a level may be too high and never too low; a key of level 0 is certainly in
one document only.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.shared import trimmed
from impressa.llm.text import mix

#: (document frequency, bits of the bitmap)
THRESHOLDS = ((2, 27), (16, 25), (128, 23), (1024, 21))
_PART_BITS = 8  # of a range of keys, at least; more with more shuffle partitions
_BITS_PER_KEY = 4  # bits of a slice for each key that may set one
_HELD = 2_000_000
ID_BITS = 26


def levels_of(levels: list, keys: np.ndarray) -> np.ndarray:
    """How many thresholds each key reaches; levels are (bits, bitmap) pairs as broadcast, plain arrays that workers without this library can load."""
    high, level = (keys >> np.uint64(32)).astype(np.int64), np.zeros(len(keys), np.uint8)
    rest = np.arange(len(keys))
    for bits, known in levels:
        at = high[rest] >> (32 - bits)
        rest = rest[(known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        level[rest] += 1
    return level


def _levels(thresholds, slices, part_bits: int) -> list:
    levels = [(b, np.zeros(1 << (b - 3), np.uint8)) for _, b in thresholds]
    for part, level, data in slices:
        bits, known = levels[level]
        size = 1 << (bits - 3 - part_bits)
        known[part * size : (part + 1) * size] = np.frombuffer(data, np.uint8)
    return levels


def frequency_levels(rows: DataFrame, keys_of, thresholds=THRESHOLDS):
    """Broadcast levels (see :func:`levels_of`) over the keys that ``keys_of(batch)`` yields as (document number in the batch, keys)."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_bits = min(max(_PART_BITS, (width - 1).bit_length()), min(b for _, b in thresholds) - 3)

    @trimmed
    def send(batches):
        held, n, seen = [], 0, 0

        def flush():
            both = np.unique(np.concatenate(held))
            high = (both >> np.uint64(32)).astype(np.uint32)
            first = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1])))
            count = np.diff(np.append(first, len(high)))
            high = high[first]
            cut = np.searchsorted(high >> np.uint32(32 - part_bits), np.arange((1 << part_bits) + 1))
            parts = np.flatnonzero(np.diff(cut))
            one, many, counts = [], [], []
            for p in parts:
                own, c = high[cut[p] : cut[p + 1]], count[cut[p] : cut[p + 1]]
                one.append(own[c == 1].tobytes())
                many.append(own[c > 1].tobytes())
                counts.append(c[c > 1].astype(np.uint32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(one, pa.binary()), pa.array(many, pa.binary()), pa.array(counts, pa.binary())], ["part", "one", "many", "counts"])

        for batch in batches:
            for doc, keys in keys_of(batch):
                if len(keys):
                    held.append((keys & np.uint64(0xFFFFFFFF00000000)) | (doc + seen).astype(np.uint64))
                    n += len(keys)
                if n >= _HELD:
                    yield flush()
                    held, n = [], 0
            seen += batch.num_rows
        if n:
            yield flush()

    @trimmed
    def add(batches):
        parts = defaultdict(list)
        for batch in batches:
            for p, one, many, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                a, b = np.frombuffer(one, np.uint32), np.frombuffer(many, np.uint32)
                parts[p].append((np.concatenate([a, b]), np.concatenate([np.ones(len(a), np.int64), np.frombuffer(counts, np.uint32)])))
        for p in sorted(parts):
            keys, counts = (np.concatenate(x) for x in zip(*parts.pop(p), strict=True))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            df, keys = np.add.reduceat(counts, first), keys[first].astype(np.int64)
            levels, slices, total = [], [], int(df.sum())
            for i, (least, bits) in enumerate(thresholds):
                size = 1 << (bits - part_bits)
                on = np.zeros(size, np.uint8)
                if i:
                    least = max(least, -(-_BITS_PER_KEY * total // size))
                on[(keys[df >= least] >> (32 - bits)) - p * size] = 1
                levels.append(i)
                slices.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(levels), pa.int32()), pa.array(levels, pa.int32()), pa.array(slices, pa.binary())], ["part", "level", "bits"])

    sent = rows.mapInArrow(send, "part int, one binary, many binary, counts binary").repartition(min(1 << part_bits, width), "part")
    slices = sent.mapInArrow(add, "part int, level int, bits binary").toArrow()
    return spark.sparkContext.broadcast(_levels(thresholds, zip(*(slices.column(i).to_pylist() for i in range(3)), strict=True), part_bits))


def id_bitmap(ids: DataFrame, bits: int = ID_BITS):
    """Broadcast bitmap of the first (long) column of ids; see :func:`maybe_in`."""

    @trimmed
    def words(batches):
        for batch in batches:
            at = np.unique(_place(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["w", "b"])

    found = ids.mapInArrow(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out)


def _place(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def maybe_in(known: np.ndarray, ids: pa.Array) -> np.ndarray:
    """False only for ids that are certainly not in the bitmap; null ids are not."""
    at = _place(ids.fill_null(0).to_numpy(zero_copy_only=False), int(len(known)).bit_length() - 1 + 6)
    return ((known[at >> 6] >> (at & 63)) & 1 == 1) & ids.is_valid().to_numpy(zero_copy_only=False)

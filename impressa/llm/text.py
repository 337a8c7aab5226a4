"""Vectorised tokenisation of Arrow string columns, shared by the text operators.

A batch is handled in chunks of whole documents (about ``CHUNK`` bytes), so the
memory of a task depends on the longest document and not on the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1_000_000
_POWERS: dict[str, np.ndarray] = {}
_ODD = 0x9E3779B97F4A7C15 | 1
_NEXT = 0x2545F4914F6CDD1D


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Words split at ASCII white space.
SPACED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of digits, lower-case letters and every byte beyond ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Index ranges of whole documents with about ``size`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, n + 1 of each."""
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(n + 1, CHUNK + 1)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums that :func:`range_hash` turns into hashes of byte ranges."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums) - 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: each eight bytes are mixed, then mixed with their place, then added, so no form of text is known to collide."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    odd, size = np.uint64(_ODD), end - start

    def mixed(at, left, place):
        return mix(mix((eight[at].view(np.uint64).ravel() & _FIRST_BYTES[np.minimum(left, 8)]) + odd) + place * np.uint64(_NEXT))

    total = mixed(start, size, np.uint64(1))
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        first = np.cumsum(more) - more
        which = np.repeat(long, more)
        place = np.arange(len(which)) - np.repeat(first, more) + 1
        at = start[which] + 8 * place
        total[long] += np.add.reduceat(mixed(at, end[which] - at, (place + 1).astype(np.uint64)), first)
    return mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of a chunk: ``start``/``end`` byte positions, ``doc`` index and 64-bit ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.offsets, self.n_docs = offsets, len(offsets) - 1
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = table[self.data]
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begins[edge] = inside[1:-1][edge]
        ends[edge - 1] = inside[1:-1][edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets, "left")  # of each document, and the total
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    @property
    def hash(self) -> np.ndarray:
        return word_hash(self.data, self.start, self.end)

    def windows(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the runs of n words that lie within one document."""
        h = self.hash if hashes is None else hashes
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        size = len(h) - n + 1
        first = np.flatnonzero(self.doc[:size] == self.doc[n - 1 :])
        total = h[:size]
        for k in range(1, n):
            total = total * np.uint64(_NEXT) + h[k : k + size]
        return first, mix(total[first] + np.uint64(n))


def run_hash(h: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n word hashes from each of ``first``."""
    total = np.zeros(len(first), np.uint64)
    for k in range(n):
        total = total * np.uint64(_NEXT) + h[first + k]
    return mix(total + np.uint64(n))


def documents_of(batch: pa.RecordBatch, text: str, table: np.ndarray, size: int = CHUNK):
    """(first, last, Words) for each chunk of about ``size`` bytes of a batch."""
    data, offsets = string_buffer(batch.column(text))
    for first, last in chunks(offsets, size):
        own = offsets[first : last + 1]
        yield first, last, Words(data[own[0] : own[-1]], own - own[0], table)

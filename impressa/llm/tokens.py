"""Token counts by a byte-level BPE file.

The file's bytes are broadcast (a vocabulary, of fixed size), so executors need
no copy.  Texts are cut where no token crosses; a part is encoded once per worker
and found again by its hash.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from impressa.llm.text import chunks, prefix_hash, range_hash, string_buffer

_KNOWN_PART = 64  # bytes of a part that is remembered
_KNOWN = 1_000_000
_OPEN: dict = {}
#: Fixed: how byte-level BPE files of this kind split texts before merging.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: 1 letters, 2 digits, 3 marks, 0 apostrophe, white space and bytes beyond ASCII.
_KIND = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 0 if chr(b).isspace() or b == 0x27 else 3 for b in range(128)] + [0] * 128, np.uint8)
#: UTF-8 bytes of white space beyond ASCII, by length.
_WIDE_SPACE = {2: {b"\xc2\x85", b"\xc2\xa0"}, 3: {b"\xe1\x9a\x80", b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf", b"\xe2\x81\x9f", b"\xe3\x80\x80", *(bytes((0xE2, 0x80, 0x80 + k)) for k in range(11))}}


def broadcast_file(spark: SparkSession, path: str):
    """The broadcast bytes of a tokenizer file on the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _open(raw: bytes):
    """(encoder, counts known, id of a line break) of a file's bytes; one file is held per worker."""
    key = len(raw), hash(raw)
    if key not in _OPEN:
        import tiktoken

        vocabulary = json.loads(raw)["model"]["vocab"]
        # the file writes a byte as itself if it is printable, and the others, in order, as the characters from 256 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        # merges were numbered in the order in which they apply, so a token's number is its rank
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token) and not (token.startswith("<|") and token.endswith("|>"))}
        encode = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        (line,) = encode("\n")
        _OPEN.clear()
        _OPEN[key] = encode, {}, line
    return _OPEN[key]


def _odd(data: np.ndarray) -> np.ndarray:
    """Bytes of white space beyond ASCII and the separators that only some count as white space: no cut beside them."""
    odd = (data >= 0x1C) & (data <= 0x1F)
    for size, known in _WIDE_SPACE.items():
        for lead in {c[0] for c in known}:
            at = np.flatnonzero(data[: max(len(data) - size + 1, 0)] == lead)
            own = np.zeros(len(at), bool)
            for c in known:
                if c[0] == lead:
                    own |= np.logical_and.reduce([data[at + k] == c[k] for k in range(1, size)])
            for k in range(size):
                odd[at[own] + k] = True
    return odd


def _cuts(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Before which bytes a token surely begins; ``last`` marks the last byte of each text.

    These are borders of the splits that byte-level BPE makes before merging:
    where white space begins; before its last character if more follows, and
    after it unless it is a space, which joins what follows; between letters,
    digits and marks of ASCII, but for apostrophes.
    """
    odd, white = _odd(data), (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    kind = _KIND[data]
    kind[odd] = 0
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    cut[1:] |= ~white[:-1] & ~odd[:-1] & white[1:]
    plain = ~white & ~odd
    cut[:-1] |= white[:-1] & plain[1:] & ~last[:-1]
    cut[1:] |= white[:-1] & (data[:-1] != 0x20) & plain[1:]
    return cut


def count_tokens(column, raw: bytes) -> np.ndarray:
    """The number of tokens of each text of an Arrow string column; null and empty texts have none."""
    tokens_of, known, line = _open(raw)
    data, offsets = string_buffer(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for first, last in chunks(offsets):
        own, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        if len(own):
            out[first:last] = _chunk(own, at, tokens_of, known, line)
    return out


def _chunk(data: np.ndarray, offsets: np.ndarray, tokens_of, known: dict, line: int) -> np.ndarray:
    begin = np.zeros(len(data) + 1, bool)
    last = np.zeros(len(data), bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    begin[:-1] = _cuts(data, last)
    begin[offsets[:-1]] = True
    start = np.flatnonzero(begin[:-1])
    end = np.append(start[1:], len(data))
    size, n = end - start, np.zeros(len(start), np.int64)

    blank = np.concatenate(([0], np.cumsum((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)) | _odd(data))))
    single = blank[end] - blank[start] == (data[start] == 0x20)  # no white space but a leading space

    def encode(which):
        """Tokens of each part.  Single words are encoded as the lines of one text: a line break is one token and joins none of them."""
        out, lines = np.zeros(len(which), np.int64), np.flatnonzero(single[which])
        if len(lines):
            own = which[lines]
            length = size[own] + 1
            ends = np.cumsum(length)
            body = np.full(ends[-1], 0x0A, np.uint8)
            place = np.arange(ends[-1]) - np.repeat(ends - length, length)
            inside = place < np.repeat(size[own], length)
            body[inside] = data[(np.repeat(start[own], length) + place)[inside]]
            ids = np.array(tokens_of(body.tobytes().decode()))
            out[lines] = np.diff(np.flatnonzero(ids == line), prepend=-1) - 1
        for i in np.flatnonzero(~single[which]).tolist():
            p = which[i]
            out[i] = len(tokens_of(data[start[p] : end[p]].tobytes().decode()))
        return out

    short = np.flatnonzero(size <= _KNOWN_PART)
    key, at, back = np.unique(range_hash(prefix_hash(data), start[short], end[short]), return_index=True, return_inverse=True)
    counts = [known.get(k) for k in key.tolist()]
    new = np.array([i for i, c in enumerate(counts) if c is None], np.int64)
    if len(known) + len(new) > _KNOWN:
        known.clear()
    for lo in range(0, len(new), 4096):
        some = new[lo : lo + 4096]
        for i, c in zip(some.tolist(), encode(short[at[some]]).tolist(), strict=True):
            counts[i] = known[int(key[i])] = c
    n[short] = np.array(counts, np.int64)[back]
    long = np.flatnonzero(size > _KNOWN_PART)
    n[long] = encode(long)
    sums = np.concatenate(([0], np.cumsum(n)))
    return np.diff(sums[np.searchsorted(start, offsets, "left")])

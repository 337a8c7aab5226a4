"""Suffixes of one bucket range in order, by a difference cover.

The order of a text's suffixes is built one bucket at a time.  Beforehand the
cover's sample, the positions whose remainder modulo PERIOD is in COVER, is
ranked.  A bucket is then sorted by the suffixes' first PERIOD bytes, and ties
are split by ternary quicksort: for any two positions there is a shift under
PERIOD that takes both into the sample, where their ranks decide.  Memory is
the text, its sample's ranks (six of 31 positions) and one bucket.
"""

from __future__ import annotations

import numpy as np

PERIOD = 31
#: A perfect difference cover modulo PERIOD: each remainder but 0 is the difference of exactly one pair.
COVER = np.array([0, 1, 3, 8, 12, 18])
BUCKET = 1 << 19

_INDEX = np.full(PERIOD, -1)
_INDEX[COVER] = np.arange(len(COVER))
#: The least shift that takes positions of two remainders into the sample.
_SHIFT = np.array([[next(d for d in range(PERIOD) if _INDEX[(a + d) % PERIOD] >= 0 and _INDEX[(b + d) % PERIOD] >= 0) for b in range(PERIOD)] for a in range(PERIOD)])
_AT = (*range(0, PERIOD - 8, 8), PERIOD - 8)


class Suffixes:
    """Ranks of the cover sample of ``body`` by at least ``depth`` bytes, and the order of any bucket of suffixes."""

    def __init__(self, body: np.ndarray, depth: int):
        self.depth = depth
        self.body = np.concatenate([body, np.zeros(depth + 2 * PERIOD + 8, np.uint8)])
        self.words = np.ndarray((len(self.body) - 7,), ">u8", self.body, strides=(1,))
        blocks = -(-len(body) // PERIOD)
        at = (np.arange(blocks)[:, None] * PERIOD + COVER).ravel()
        self.rank, reach = self._names(at), PERIOD
        while reach < depth:
            # the sample position ``reach`` bytes on is as many places on, as reach is a multiple of PERIOD
            step = reach // PERIOD * len(COVER)
            later = np.zeros_like(self.rank)
            later[:-step] = self.rank[step:] + np.uint32(1)
            self.rank, reach = _dense(self.rank.astype(np.uint64) << np.uint64(32) | later), 2 * reach

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.words[at].astype(np.uint64)

    def _names(self, at):
        order = np.lexsort([self.word(at + k) for k in reversed(_AT)])
        new = np.zeros(len(at), np.uint32)
        for k in _AT:
            w = self.word(at[order] + k)
            new[1:] |= w[1:] != w[:-1]
        names = np.empty(len(at), np.uint32)
        names[order] = np.cumsum(new, dtype=np.uint32)
        return names

    def _ranks(self, at):
        return self.rank[at // PERIOD * len(COVER) + _INDEX[at % PERIOD]]

    def order(self, at: np.ndarray):
        """(order of the suffixes at ``at``, whether each has ``depth`` bytes in common with the one before it)."""
        order = np.lexsort([self.word(at + k) for k in reversed(_AT)])
        pos = at[order]
        same = self._same(pos, _AT)
        if self.depth > PERIOD:
            self._split(pos, order, same)
            same &= self._same(pos, (*range(PERIOD, self.depth - 8, 8), self.depth - 8))
        elif self.depth < PERIOD:
            same = self._same(pos, (*range(0, self.depth - 8, 8), self.depth - 8))
        return order, same

    def _same(self, pos, places):
        same = np.ones(len(pos), bool)
        same[:1] = False
        for k in places:
            w = self.word(pos + k)
            same[1:] &= w[1:] == w[:-1]
        return same

    def _split(self, pos, order, same):
        """Sorts the groups of equal first PERIOD bytes in place."""
        group = np.cumsum(~same)
        slots = np.flatnonzero(same | np.append(same[1:], False))
        group = group[slots]
        while len(slots):
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            size = np.diff(np.append(first, len(slots)))
            p = pos[slots]
            pivot = np.repeat(p[first + size // 2], size)
            d = _SHIFT[p % PERIOD, pivot % PERIOD]
            mine, other = self._ranks(p + d), self._ranks(pivot + d)
            side = (mine > other).astype(np.int64) - (mine < other) + 1
            key = np.repeat(np.arange(len(first)) * 3, size) + side
            moved = np.argsort(key, kind="stable")
            pos[slots], order[slots] = p[moved], order[slots][moved]
            key = key[moved]
            alone = np.concatenate(([True], key[1:] != key[:-1]))
            alone &= np.append(alone[1:], True)
            left = (key % 3 != 1) & ~alone
            slots, group = slots[left], key[left]


def _dense(keys):
    order = np.argsort(keys)
    names = np.empty(len(keys), np.uint32)
    names[order] = np.cumsum(np.concatenate(([False], keys[order][1:] != keys[order][:-1])), dtype=np.uint32)
    return names


def buckets(suffixes: Suffixes, at: np.ndarray, most: int = BUCKET):
    """Indices into ``at`` by bucket: ranges of the first eight bytes of about ``most`` suffixes."""
    if len(at) <= most:
        yield np.arange(len(at))
        return
    first = suffixes.word(at)
    drawn = np.sort(first[:: max(1, len(at) // 65536)])
    bounds = np.unique(drawn[np.linspace(0, len(drawn) - 1, -(-len(at) // most) + 1).astype(int)[1:-1]])
    bucket = np.searchsorted(bounds, first, "right").astype(np.uint16)
    for b in range(len(bounds) + 1):
        own = np.flatnonzero(bucket == b)
        if len(own):
            yield own

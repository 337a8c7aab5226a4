"""Periodic runs of words, found by probing harmonic grids.

A run is a stretch of consecutive words whose smallest period is q, at least
``max(least, 2 * q)`` words long, that no neighbouring word extends.  Such a
stretch has words q apart that are equal over q positions or more, so it holds
a grid point jq with word[jq] == word[(j + 1)q].  For each period p the grid
points 0, p, 2p... are probed, which is n/1 + n/2 + n/3... probes a text;
survivors are extended to both sides by comparing slices of growing length.
Grid points within a run that is already found, whose period divides p, are
skipped: they would give that run again.  A stretch with both ends of a known
run has a smaller period than p and is the same run.

Words are compared exactly (they are numbered by an Arrow dictionary), texts
one by one, so nothing is shuffled and a task holds about a megabyte of texts,
or one text if that is longer, with some 50 bytes a word.

Null and empty texts have no words and no runs; a null identifier passes
through; repeated rows each get their own row; further columns, whatever their
names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impressa.llm.shared import keyed, trimmed
from impressa.llm.text import chunks, string_buffer

#: Words of the shortest run.
LEAST = 12
_PROBES = 1 << 16  # at a time
_EDGE = 4


def _ahead(w: np.ndarray, i: int, p: int, n: int) -> int:
    """The first position from i on whose word differs from the one p later; n - p at most."""
    size = 32
    while i < n - p:
        size = min(size, n - p - i)
        bad = w[i : i + size] != w[i + p : i + p + size]
        if bad.any():
            return i + int(bad.argmax())
        i, size = i + size, min(4 * size, 1 << 16)
    return n - p


def _back(w: np.ndarray, i: int, p: int) -> int:
    """The smallest s with equal words p apart from s up to i."""
    size = 32
    while i > 0:
        size = min(size, i)
        bad = w[i - size : i] != w[i - size + p : i + p]
        if bad.any():
            return i - int(bad[::-1].argmax())
        i, size = i - size, min(4 * size, 1 << 16)
    return 0


def _near(padded: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which grid points have two equal words after them, or four before: others belong to less than six in a row."""
    at = at + _EDGE

    def same(k):
        return padded[at + k] == padded[at + k + period]

    return (same(1) & same(2)) | (same(-1) & same(-2) & same(-3) & same(-4))


def runs_of(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start and period."""
    if least < 12:
        raise ValueError("a run has twelve words at least")
    n, found, spans, first = len(w), [], set(), 1
    if n < least:
        return []
    edge = np.arange(-2 * _EDGE, 0)
    padded = np.concatenate([edge[:_EDGE], w, edge[_EDGE:]])
    open_runs: list[tuple[int, int, int]] = []
    while first <= n // 2:
        periods = np.arange(first, min(n // 2, first + _PROBES // max(1, (n - 1) // first)) + 1)
        points = (n - 1) // periods
        periods = periods[: max(1, int(np.searchsorted(np.cumsum(points), _PROBES, "right")))]
        points = points[: len(periods)]
        offset = np.cumsum(points) - points
        period = np.repeat(periods, points)
        at = (np.arange(len(period)) - np.repeat(offset, points)) * period
        alive = w[at] == w[at + period]
        open_runs = [r for r in open_runs if r[1] > first]
        for s, length, q in open_runs:
            for p in range(-(-first // q) * q, min(int(periods[-1]), length - 1) + 1, q):
                j = int(offset[p - first])
                alive[j - (-s // p) : j + max((s + length - 1 - p) // p + 1, 0)] = False
        rest = np.flatnonzero(alive)
        rest = rest[_near(padded, at[rest], period[rest])]
        last, end = 0, 0
        for i, p in zip(at[rest].tolist(), period[rest].tolist(), strict=True):
            if p == last and i < end:
                continue
            last, end = p, _ahead(w, i, p, n)
            s = _back(w, i, p)
            if end + p - s >= max(least, 2 * p) and (s, end + p) not in spans:
                spans.add((s, end + p))
                found.append((s, end + p - s, p))
                open_runs.append(found[-1])
        first = int(periods[-1]) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        change[s + q] += 1
        change[s + length] -= 1
    return np.cumsum(change[:-1]) == 0


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and collapsed, the text whose runs are cut to their first period, words joined by one space."""

    @trimmed
    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            _, offsets = string_buffer(batch.column("text"))
            for first, last in chunks(offsets):
                ids, texts = batch.column("doc_id").slice(first, last - first), pc.fill_null(batch.column("text").slice(first, last - first), "")
                lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
                words, cut = lists.flatten(), lists.offsets.to_numpy()
                cut = cut - cut[0]
                codes = words.dictionary_encode().indices.to_numpy()
                joined = pc.binary_join(lists, " ")
                empty = pc.equal(joined, "").to_numpy(zero_copy_only=False)
                counts, runs, collapsed = [], [], []
                for k in range(last - first):
                    n = 0 if empty[k] else int(cut[k + 1] - cut[k])
                    own = runs_of(codes[cut[k] : cut[k] + n], least)
                    counts.append(n)
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                    if own:
                        kept = words.take(pa.array(cut[k] + np.flatnonzero(_kept(n, own))))
                        collapsed.append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), " ")[0])
                    else:
                        collapsed.append(joined[k])
                texts = pa.array([x.as_py() for x in collapsed], pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(runs, kind), texts], ["doc_id", "n_words", "runs", "collapsed"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_periodic_tail(text: str, h: Column) -> Column:
    """The text, or, where h modulo 10 is 0, its words joined by one space with all words from a on repeating period p: a and p follow from h."""
    words, g = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != ""), F.floor(h / 10)

    def planted(x):
        n = F.size(x).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(x, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))

    made = F.get(F.transform(F.array(words), lambda x: F.when(F.size(x) > 0, planted(x))), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(made, F.col(text))).otherwise(F.col(text))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one (ties: smallest start, then period) and digests of the runs and of the collapsed text."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])))
    best = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), (-F.col("_best.less")).alias("length"), F.col("_best.period").alias("period"),
        F.expr("div(-1000 * _best.less, _best.period)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

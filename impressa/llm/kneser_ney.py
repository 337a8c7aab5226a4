"""Interpolated modified Kneser-Ney language model.

Tokens are words split at ASCII white space (A-Z lower-cased), then one end per
text.  N-grams are counted in Spark: tasks send distinct n-grams with counts, by
the last word of their context, so one partition holds everything that follows
a word: its n-grams of every order, their contexts and the continuation counts
of the next lower order.  Words that precede a large share of all tokens are
spread over several partitions by the word that follows; only the contexts that
end in one of them, and the words themselves, are summed in a second, small
shuffle.  No n-gram, count or context goes through the driver.

The model is a folder of sorted hash arrays: each partition has one file, which
its reducer writes once.  Workers memory-map the files, so pages are shared and
read as needed.  The folder must be mounted on all machines; it is made under
spark.checkpoint.dir.  Files are written under a name of their own and renamed,
so a retried task does no harm.

Words are told apart by 48 bits of their hash, in the arrays too: of n distinct
words about n * n / 2**49 share an id (none in the test tables, 30 of 130
million), and an unseen word is taken for one of n known ones once in 2**48 / n
times.  An n-gram takes four bytes, a code for its count and 24 bits of its
hash, beside those that its partition and bucket imply: an n-gram that was never
seen is taken for a seen one about once in two million times.  The training job
returns the names and sizes of the files; scoring fails if one is missing or
cut short.  Highest-order n-grams seen up to ``prune`` times
(0 or 1) are not stored: they count in every statistic, and their mass goes to
the lower order.  The query stores all of them and takes trigrams.

Null and empty texts are one end token; repeated rows count as often as they
occur; a null id is training data with remainder null (held_out null); with no
training text every token has the uniform probability; a text longer than a
chunk is a chunk of its own; further columns, whatever their names, are not
read.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.shared import remainder, shared_dir, small_batches, trimmed
from impressa.llm.text import SPACED, documents_of, mix

ORDER = 2
PRUNE = 1
#: The share of texts from which frequent words are chosen, and their number; they decide how work is dealt and sent, and no result.
SHARE = 0.05
FREQUENT = 65_535
_HELD = 2_500_000
_SCORED_BYTES = 2_000_000
_ID = np.uint64(0xFFFFFFFFFFFF0000)  # the bits of a word's hash that are its id
_BEGIN, _END = np.uint64(1 << 16), np.uint64(2 << 16)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COMMON = 255  # a code of one byte for each of so many frequent values; the last code marks the others
_OPEN: dict = {}


def _tokens(w, order: int):
    """Word ids of a chunk with begin and end marks: (ids, positions of the tokens scored, their documents, their ids)."""
    h = np.maximum(w.hash & _ID, np.uint64(3 << 16))
    lead = order - 1
    size = w.count + lead + 1
    base = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(base[-1]), _BEGIN, np.uint64)
    out[base[w.doc] + lead + np.arange(len(h)) - w.first[w.doc]] = h
    out[base[1:] - 1] = _END
    at = np.arange(len(out))
    scored = at[(at - np.repeat(base[:-1], size)) >= lead]
    return out, scored, np.repeat(np.arange(w.n_docs), w.count + 1), out[scored]


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of rows of word ids."""
    total = np.full(len(columns[0]), len(columns) + 1, np.uint64)
    for c in columns:
        total = mix(total * np.uint64(0x2545F4914F6CDD1D) + c)
    return total


def _unique(columns: list[np.ndarray], counts: np.ndarray):
    """Distinct rows of word ids with summed counts."""
    key = _key(columns)
    order = np.argsort(key)
    new, changed = np.ones(len(key), bool), np.zeros(max(len(key) - 1, 0), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    for c in columns:
        c = c[order]
        changed |= c[1:] != c[:-1]
    if (changed & ~new[1:]).any():  # rows whose hashes collide may be mixed
        order = np.lexsort(columns[::-1])
        new[1:] = False
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.add.reduceat(counts[order], first)


def _partition(last: np.ndarray, word: np.ndarray, meta: dict):
    """(partition, is the context's last word spread?) of n-grams by that word; the followers of one that is spread are dealt by themselves."""
    seed, ids = mix(last ^ _ODD), meta["spread_ids"]
    spread = np.zeros(len(last), bool)
    if len(ids):
        at = np.minimum(np.searchsorted(ids, last), len(ids) - 1)
        spread = ids[at] == last
        salt = mix(word[spread]) % meta["spread_over"][at[spread]] + np.uint64(1)
        seed[spread] = mix(seed[spread] + salt * _ODD)
    return ((seed >> np.uint64(32)) * np.uint64(meta["parts"]) >> np.uint64(32)).astype(np.int64), spread


def _range(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _groups(part: np.ndarray):
    """(number, indices) of each group of equal numbers."""
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(own):
            yield int(part[own[0]]), own


# --- what tasks send -----------------------------------------------------------------------------

_ROWS = "kind string, level int, part int, n int, others int, size int, body binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _row(kind, level, part, n, others, body: bytes):
    small = pa.Codec("zstd", compression_level=3).compress(body, asbytes=True) if body else b""
    return pa.RecordBatch.from_arrays([pa.array([kind]), *(pa.array([x], pa.int32()) for x in (level, part, n, others, len(body))), pa.array([small], pa.binary())], _NAMES)


def _body(row) -> bytes:
    return pa.Codec("zstd").decompress(row["body"], row["size"], asbytes=True) if row["size"] else b""


def _gram_row(level: int, part: int, columns, counts, meta: dict):
    """N-grams sorted by their contexts and split in byte planes, which compress well: two bytes for a frequent word, zero and its id for another."""
    ids, numbers = meta["frequent_ids"], np.zeros((len(columns), len(counts)), np.uint16)
    if len(ids):
        for j, c in enumerate(columns):
            at = np.minimum(np.searchsorted(ids, c), len(ids) - 1)
            numbers[j] = np.where(ids[at] == c, meta["frequent_numbers"][at], 0)
    order = np.lexsort((numbers[-1], numbers[0], columns[-2], numbers[-2]))
    numbers = np.ascontiguousarray(numbers[:, order])
    others = np.concatenate([c[order][own == 0] for c, own in zip(columns, numbers, strict=True)])
    planes = numbers.view(np.uint8).reshape(len(columns), -1, 2).transpose(0, 2, 1)
    wide = counts[order].astype(np.int64).view(np.uint8).reshape(-1, 8).T
    return _row("gram", level, part, len(counts), len(others), b"".join((others.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes(), planes.tobytes(), wide.tobytes())))


def _grams(row, meta: dict):
    """The columns and counts of a row of n-grams."""
    body, n, level, at = np.frombuffer(_body(row), np.uint8), row["n"], row["level"], 6 * row["others"]
    others = np.zeros((row["others"], 8), np.uint8)
    others[:, 2:] = body[:at].reshape(-1, 6)
    planes = body[at : at + 2 * level * n].reshape(level, 2, n)
    numbers = planes[:, 0].astype(np.uint16) | planes[:, 1].astype(np.uint16) << np.uint16(8)
    columns = meta["frequent"][numbers]
    columns[numbers == 0] = others.view(np.uint64).ravel()
    counts = np.ascontiguousarray(body[at + 2 * level * n :].reshape(8, n).T).view(np.int64).ravel()
    return [*columns, counts]


def _sum_row(kind: str, level: int, part: int, keys, values):
    """Keys with rows of numbers to be added up."""
    order = np.argsort(keys)
    return _row(kind, level, part, len(keys), values.shape[1], keys[order].tobytes() + np.ascontiguousarray(values[order], np.int64).view(np.uint8).reshape(len(keys), -1).T.tobytes())


def _sums(rows):
    """Distinct keys and added values of such rows."""
    keys, values = [], []
    for r in rows:
        body = np.frombuffer(_body(r), np.uint8)
        keys.append(body[: 8 * r["n"]].view(np.uint64))
        values.append(np.ascontiguousarray(body[8 * r["n"] :].reshape(-1, r["n"]).T).view(np.int64).reshape(r["n"], -1))
    return _added(np.concatenate(keys), np.concatenate(values))


def _added(keys, values):
    order = np.argsort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    return keys[order[first]], np.add.reduceat(values[order], first, axis=0)


def _in_turn(batches, *names):
    """Lists of rows that agree in the columns named; rows come sorted by them."""
    held = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[c] != held[0][c] for c in names):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


# --- the model's files ---------------------------------------------------------------------------


def _array(keys: np.ndarray, values: np.ndarray, whole: bool = False) -> bytes:
    """A sorted hash array: buckets by the leading bits; for each key 24 further bits and a code of 8 for its row of values; whole: all bits beside them."""
    n, m = values.shape
    bits = max(1, int(n // 8).bit_length())
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    offsets = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    rest = (keys >> np.uint64(40 - bits)).astype(np.uint32) << np.uint32(8)
    small = (values < 31).all(1)
    packed = (np.minimum(values, 31) << (5 * np.arange(m))).sum(1)
    found, times = np.unique(packed[small], return_counts=True)
    common = np.sort(found[np.argsort(-times, kind="stable")[:_COMMON]])
    code = np.full(n, _COMMON, np.uint8)
    if len(common):
        at = np.minimum(np.searchsorted(common, packed), len(common) - 1)
        hit = small & (common[at] == packed)
        code[hit] = at[hit]
    table = np.zeros((_COMMON + 1, m), np.int64)
    table[: len(common)] = common[:, None] >> (5 * np.arange(m)) & 31
    big = np.flatnonzero(code == _COMMON)
    parts = [np.array([n, m, bits, len(big), whole]), table, big, values[big].astype(np.int64), offsets, rest | code, keys[: n * whole]]
    return b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in parts)


class _Array:
    """A view of what :func:`_array` wrote."""

    def __init__(self, raw: np.ndarray):
        n, self.m, self.bits, n_big, whole = raw[:40].view(np.int64).tolist()
        at = 40

        def take(kind, *shape):
            nonlocal at
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            out = raw[at : at + size].view(kind).reshape(shape)
            at += size + -size % 8
            return out

        self.table, self.big, self.values = take(np.int64, _COMMON + 1, self.m), take(np.int64, n_big), take(np.int64, n_big, self.m)
        self.offsets, self.entries = take(np.uint32, (1 << self.bits) + 1), take(np.uint32, n)
        self.keys = take(np.uint64, n) if whole else None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, zeros where absent."""
        if self.keys is not None:
            low = np.searchsorted(self.keys, keys)
            hit = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(0, np.int64)
            return self._values(len(keys), hit, low[hit])
        bucket, least = (keys >> np.uint64(64 - self.bits)).astype(np.int64), (keys >> np.uint64(40 - self.bits)).astype(np.uint32) << np.uint32(8)
        low, end = self.offsets[bucket].astype(np.int64), self.offsets[bucket + 1].astype(np.int64)
        high = end
        for _ in range(int((end - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            less = (low < high) & (self.entries[np.minimum(middle, len(self.entries) - 1)] < least)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        hit = np.flatnonzero(low < end)
        hit = hit[(self.entries[low[hit]] ^ least[hit]) < 256]
        return self._values(len(keys), hit, low[hit])

    def _values(self, n: int, hit: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, code = np.zeros((n, self.m), np.int64), self.entries[at] & np.uint32(255)
        out[hit] = self.table[code]
        rare = code == _COMMON
        if rare.any():
            out[hit[rare]] = self.values[np.searchsorted(self.big, at[rare])]
        return out


def _write(path: str, name: str, arrays: dict[tuple[str, int], bytes]) -> int:
    """One file of several arrays, renamed when complete; its size."""
    os.makedirs(path, exist_ok=True)
    own = f"{path}/.{uuid.uuid4().hex}"
    head, at = [len(arrays)], 8 * (1 + 3 * len(arrays))
    for (kind, level), data in arrays.items():
        head += [level * 2 + (kind == "context"), at, len(data)]
        at += len(data)
    with open(own, "wb") as f:
        f.write(np.array(head, np.int64).tobytes())
        for data in arrays.values():
            f.write(data)
    os.replace(own, f"{path}/{name}")
    return at


class Model:
    """Memory-mapped files of a model folder."""

    def __init__(self, path: str, meta: dict):
        self.path, self.meta, self.files = path, meta, {}

    def _arrays(self, name: str) -> dict:
        if name not in self.files:
            where = f"{self.path}/{name}"
            self.files[name] = {}
            if name in self.meta["files"]:
                if not os.path.exists(where) or os.path.getsize(where) != self.meta["files"][name]:
                    raise FileNotFoundError(f"{where} of the model is missing or cut short: spark.checkpoint.dir must be one folder for all machines")
                raw = np.asarray(np.memmap(where, np.uint8, "r"))
                head = raw[8 : 8 + 24 * int(raw[:8].view(np.int64)[0])].view(np.int64).reshape(-1, 3)
                self.files[name] = {("context" if k % 2 else "gram", k // 2): _Array(raw[at : at + size]) for k, at, size in head.tolist()}
        return self.files[name]

    def _by_range(self, name: str, what: tuple[str, int], keys: np.ndarray, columns: int) -> np.ndarray:
        """Values from the files that are split by ranges of the key; each key is looked up once."""
        some, back = np.unique(keys, return_inverse=True)
        values = np.zeros((len(some), columns), np.int64)
        for part, own in _groups(_range(some, self.meta["parts"])):
            held = self._arrays(f"{name}-{part}").get(what)
            if held is not None:
                values[own] = held.find(some[own])
        return values[back]

    def words(self, ids: np.ndarray) -> np.ndarray:
        """(continuation count, count) of words."""
        return self._by_range("words", ("gram", 1), ids, 2)

    def probability(self, ids: np.ndarray, at: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """Probability of the tokens at positions ``at`` given the ids before them."""
        order, discounts = self.meta["order"], self.meta["discounts"]
        words = self.words(ids[at]) if words is None else words
        p = _step(words[:, 0], self.meta["context"], discounts[1], np.full(len(at), 1 / (self.meta["words"] + 1)), False)
        part, spread = _partition(ids[at - 1], ids[at], self.meta)
        levels = range(2, order + 1)
        columns = {n: [ids[at - n + 1 + k] for k in range(n)] for n in levels}
        keys = {n: (_key(columns[n]), _key(columns[n][:-1])) for n in levels}
        count, context = {n: np.zeros(len(at), np.int64) for n in levels}, {n: np.zeros((len(at), 4), np.int64) for n in levels}
        for number, own in _groups(part):
            held, near = self._arrays(f"grams-{number}"), own[~spread[own]]
            for n in levels:
                if ("gram", n) in held:
                    count[n][own] = held["gram", n].find(keys[n][0][own])[:, 0]
                if ("context", n) in held:
                    context[n][near] = held["context", n].find(keys[n][1][near])
        far = np.flatnonzero(spread)
        for n in levels:
            if len(far):
                context[n][far] = self._by_range(f"contexts{n}", ("context", n), keys[n][1][far], 4)
            p = _step(count[n], context[n].T, discounts[n], p, n == order and self.meta["prune"])
        return p


def _step(count, context, discounts, lower, pruned):
    """Interpolated probability from a count, the statistics of its context and the lower order."""
    total, n1, n2, n3 = context
    d = np.array([0.0, *discounts])
    left = n1 * (1.0 if pruned else d[1]) + n2 * d[2] + n3 * d[3]
    own = np.maximum(count - d[np.minimum(count, 3)], 0.0)
    return np.where(total > 0, (own + left * lower) / np.maximum(total, 1), lower)


def open_model(path: str, meta: dict) -> Model:
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Model(path, meta)
    return _OPEN[path]


def model_folder(docs: DataFrame) -> str:
    """A new folder under the shared one; it must be a mounted path, as files are memory-mapped."""
    where = urlparse(shared_dir(docs.sparkSession))
    if where.scheme not in ("", "file"):
        raise ValueError(f"a memory-mapped model needs a mounted folder in spark.checkpoint.dir, not {where.scheme}://")
    return f"{unquote(where.path)}/kneser-ney-{uuid.uuid4().hex}"


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more from the counts of counts."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [float(min(max(x, 0.05), k - 0.05)) for k, x in enumerate(d, 1)]


def _frequent(texts: DataFrame, parts: int) -> dict:
    """The frequent words of a share of the texts: up to FREQUENT of them are sent as short numbers, and those that precede more than half a
    partition's share of the tokens (at most 2 * parts) are spread over several partitions."""

    @trimmed
    def run(batches):
        held = [np.zeros(0, np.uint64)]
        for batch in batches:
            for _, _, w in documents_of(batch, "text", SPACED):
                ids, at, _, _ = _tokens(w, 2)
                held.append(ids[at - 1])
        ids, counts = np.unique(np.concatenate(held), return_counts=True)
        n, often = int(counts.sum()), np.argsort(-counts, kind="stable")[:FREQUENT]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids[often], 0).view(np.int64)), pa.array(np.append(counts[often], n))], ["id", "n"])

    found = texts.sample(SHARE, seed=1).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(FREQUENT + 1).toArrow()
    ids, counts = found["id"].to_numpy().view(np.uint64), found["n"].to_numpy()
    total = int(counts[ids == 0].sum())
    ids, counts = ids[ids > 0], counts[ids > 0]
    order = np.argsort(ids)
    spread = order[2 * parts * counts[order] > total]
    return {
        "frequent": np.append(np.uint64(0), ids), "frequent_ids": ids[order], "frequent_numbers": (order + 1).astype(np.uint16),
        "spread_ids": ids[spread], "spread_over": np.array([-(-2 * parts * n // total) for n in counts[spread].tolist()], np.uint64)}


def train(texts: DataFrame, order: int = ORDER, prune: int = PRUNE) -> tuple[str, dict]:
    """Count n-grams of a column ``text`` and write the model; (folder, meta)."""
    if order < 2 or prune not in (0, 1):
        raise ValueError("order must be 2 or more, prune 0 or 1")
    spark, path = texts.sparkSession, model_folder(texts)
    texts = texts.select("text")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * width
    meta = {"order": order, "prune": prune, "parts": parts, **_frequent(texts, parts)}

    @trimmed
    def count(batches):
        held, n = [], 0

        def flush():
            columns = [np.concatenate([ids[at - order + 1 + k] for ids, at in held]) for k in range(order)]
            held.clear()
            columns, counts = _unique(columns, np.ones(len(columns[0]), np.int64))
            part, _ = _partition(columns[-2], columns[-1], meta)
            for p, own in _groups(part):
                yield _gram_row(order, p, [c[own] for c in columns], counts[own], meta)

        for batch in batches:
            for _, _, w in documents_of(batch, "text", SPACED):
                ids, at, _, _ = _tokens(w, order)
                held.append((ids, at))
                n += len(at)
                if n >= _HELD:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()

    @trimmed
    def add(batches):
        tally, words, n_words = np.zeros((order + 1, 4), np.int64), [], 0

        def send_words():
            keys, values = _added(np.concatenate([k for k, _ in words]), np.concatenate([v for _, v in words]))
            words.clear()
            for p, own in _groups(_range(keys, parts)):
                yield _sum_row("word", 1, p, keys[own], values[own])

        for rows in _in_turn(batches, "part"):
            *columns, counts = (np.concatenate(x) for x in zip(*(_grams(r, meta) for r in rows), strict=True))
            columns, counts = _unique(columns, counts)
            tokens = np.unique(columns[-1], return_inverse=True)
            tokens = tokens[0], np.bincount(tokens[1], counts).astype(np.int64)
            arrays = {}
            for level in range(order, 1, -1):
                tally[level] += [(counts == k).sum() for k in (1, 2, 3, 4)]
                stored = counts > (prune if level == order else 0)
                arrays["gram", level] = _array(_key(columns)[stored], counts[stored][:, None])
                # contexts: total count and numbers of followers seen once, twice, more often
                context = _key(columns[:-1])
                by = np.argsort(context)
                first = np.flatnonzero(np.concatenate(([True], context[by][1:] != context[by][:-1])))
                stats = np.stack([np.add.reduceat(x[by].astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2)], axis=1)
                context, far = context[by][first], _partition(columns[-2][by][first], columns[-1][by][first], meta)[1]
                arrays["context", level] = _array(context[~far], stats[~far])
                for p, own in _groups(_range(context[far], parts)):
                    yield _sum_row("context", level, p, context[far][own], stats[far][own])
                columns, counts = _unique(columns[1:], np.ones(len(counts), np.int64))
            yield _row("file", 0, rows[0]["part"], 0, 0, np.array([_write(path, f"grams-{rows[0]['part']}", arrays)]).tobytes())
            by = np.argsort(columns[0])
            words.append((columns[0][by], np.stack([counts[by], tokens[1]], axis=1)))
            n_words += len(by)
            if n_words >= _HELD:
                yield from send_words()
                n_words = 0
        if words:
            yield from send_words()
        for level in range(2, order + 1):
            yield _row("tally", level, 0, 0, 0, tally[level].tobytes())

    @trimmed
    def finish(batches):
        out = []
        for rows in _in_turn(batches, "kind", "level", "part"):
            kind, level, part = (rows[0][c] for c in ("kind", "level", "part"))
            if kind == "tally":
                out += [("", level, *np.frombuffer(_body(r), np.int64).tolist(), 0, 0, 0) for r in rows]
                continue
            if kind == "file":
                name, size = f"grams-{part}", int(np.frombuffer(_body(rows[0]), np.int64)[0])
            elif kind == "context":
                name = f"contexts{level}-{part}"
                size = _write(path, name, {("context", level): _array(*_sums(rows))})
            else:
                keys, values = _sums(rows)
                name = f"words-{part}"
                size = _write(path, name, {("gram", 1): _array(keys, values, whole=True)})
                out.append(("", 1, *[int((values[:, 0] == k).sum()) for k in (1, 2, 3, 4)], int(values[:, 0].sum()), int(values[:, 1].sum()), len(keys)))
            out.append((name, 0, size, 0, 0, 0, 0, 0, 0))
        names, *numbers = list(zip(*out, strict=True)) or [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(c, pa.int64()) for c in numbers)], ["file", "level", "n1", "n2", "n3", "n4", "pairs", "tokens", "words"])

    grams = texts.mapInArrow(count, _ROWS).repartition(width, "part").sortWithinPartitions("part").mapInArrow(add, _ROWS)
    ends = grams.repartition(width, "kind", "level", "part").sortWithinPartitions("kind", "level", "part")
    sums = ends.mapInArrow(finish, "file string, level long, n1 long, n2 long, n3 long, n4 long, pairs long, tokens long, words long")
    # a row per level and one per file: four files and more a shuffle partition, as the partitions' number and not the corpus has it
    found = sums.groupBy("file", "level").agg(*[F.sum(c).alias(c) for c in sums.columns[2:]]).collect()
    meta["files"] = {r.file: r.n1 for r in found if r.file}
    found = {r.level: r for r in found if not r.file}
    meta["discounts"] = {n: _discounts([found[n][f"n{k}"] for k in (1, 2, 3, 4)] if n in found else [0] * 4) for n in range(1, order + 1)}
    one = found.get(1)
    n1, n2, pairs = (one.n1, one.n2, one.pairs) if one else (0, 0, 0)
    meta |= {"tokens": one.tokens if one else 0, "words": one.words if one else 0, "context": (pairs, n1, n2, (one.words if one else 0) - n1 - n2)}
    return path, meta


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prune: int = PRUNE, folds: int = 7, held_out: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from documents whose crc32(doc_id) mod ``folds`` is not
    ``held_out``.  Scores are log10 probabilities of the whole text.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("held_out", remainder("doc_id", folds) == held_out)
    path, meta = train(rows.where(~F.coalesce("held_out", F.lit(False))), order, prune)

    @trimmed
    def run(batches):
        for batch in batches:
            model, parts = open_model(path, meta), []
            for _, _, w in documents_of(batch, "text", SPACED, _SCORED_BYTES):
                ids, at, doc, own = _tokens(w, order)
                words = model.words(own)
                base = np.log10((words[:, 1] + 1) / (meta["tokens"] + meta["words"] + 1))
                p = np.log10(model.probability(ids, at, words))
                parts.append((w.count + 1, np.bincount(doc, words[:, 1] > 0, minlength=w.n_docs), np.bincount(doc, base, minlength=w.n_docs), np.bincount(doc, p, minlength=w.n_docs)))
            n, known, base, p = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), meta["tokens"], np.int64)), pa.array(base), pa.array(p), pa.array(10.0 ** np.minimum(-p / np.maximum(n, 1), 300))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

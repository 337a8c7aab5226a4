"""Plain Python versions of the training-data operators."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def words(text, pattern=WORD):
    return pattern.findall((text or "").translate(_LOWER))


def components(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def jaccard(docs, n=5):
    """{doc_id: (set size, component)}"""
    sets = {}
    for i, t in docs.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in docs}


def kneser_ney(docs, prune):
    """{doc_id: log10 probability} by a model of order 2, learnt outside fold 2 of 7."""
    begin, end = object(), object()
    pairs = {i: list(zip([begin, *words(t)], [*words(t), end], strict=True)) for i, t in docs.items()}
    two = Counter(p for i in docs if fold(i, 7) != 2 for p in pairs[i])
    one = Counter(b for _, b in two)

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0, 0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 2]
        return [0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))]

    def step(own, followers, d, lower, cut):
        if not followers:
            return lower
        left = sum(1 if c <= cut else d[min(c, 3)] for c in followers)
        return (max(own - d[min(own, 3)], 0) * (own > cut) + left * lower) / sum(followers)

    d1, d2, after = discounts(one), discounts(two), defaultdict(list)
    for (a, _), c in two.items():
        after[a].append(c)
    low = defaultdict(lambda: step(0, one.values(), d1, 1 / (len(one) + 1), 0))
    low |= {b: step(c, one.values(), d1, 1 / (len(one) + 1), 0) for b, c in one.items()}
    return {i: sum(math.log10(step(two[a, b], after.get(a), d2, low[b], prune)) for a, b in own) for i, own in pairs.items()}


def substrings(docs, n=50):
    """{doc_id: (bytes, removed, spans, kept)}"""
    first, out = {}, {}
    raw = {i: (t or "").encode() for i, t in docs.items()}
    for i in sorted(raw):
        for k in range(len(raw[i]) - n + 1):
            first.setdefault(raw[i][k : k + n], i)
    for i, b in raw.items():
        gone = [False] * len(b)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = [True] * n
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


def contamination(docs, benchmark, n=13):
    """{doc_id: (words, hit, items)}"""
    windows = defaultdict(set)
    for i, t in benchmark:
        w = words(t, ITEM_WORD)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    out, sizes = {}, {len(k) for k in windows}
    for i, t in docs.items():
        w, hit, items = words(t, ITEM_WORD), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    items |= found
        out[i] = len(w), len(hit), items
    return out


def near_vectors(vectors, cosine=0.95):
    """{vec_id: (links, component)}"""
    good = {}
    for i, v in vectors.items():
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            size = math.sqrt(sum(x * x for x in v))
            good[i] = [x / size for x in v]
    links = [(a, b) for a in good for b in good if a < b and sum(x * y for x, y in zip(good[a], good[b], strict=True)) >= cosine]
    comp, n = components(vectors, links), Counter(x for p in links for x in p)
    return {i: (n[i], comp[i]) for i in vectors}


def warc(pages):
    """{page_id: (bytes, digest, type, refers_to)}"""
    last, raw = {}, {i: (h or "").encode() for i, h in pages.items()}
    for i, b in raw.items():
        last[b] = max(i, last.get(b, i))
    digest = {i: base64.b32encode(hashlib.sha1(b).digest()).decode() for i, b in raw.items()}
    return {i: (len(b), digest[i], "response" if last[b] == i else "revisit", None if last[b] == i else last[b]) for i, b in raw.items()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def unigram(docs):
    """({doc_id: (tokens, known, base score)}, training tokens)"""
    tokens = {i: [*words(t), None] for i, t in docs.items()}
    c = Counter(x for i, t in tokens.items() if fold(i, 7) != 2 for x in t)
    total, v = sum(c.values()), len(c)
    return {i: (len(t), sum(c[x] > 0 for x in t), sum(math.log10((c[x] + 1) / (total + v + 1)) for x in t)) for i, t in tokens.items()}, total


LISTED = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def url(u):
    """(host, path, rule, verdict), the last two null without a listed rule."""
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(_LOWER)
    fits = [(len(h + p), h + p, v) for h, p, v in LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)

"""One key with very many different contexts."""

import hashlib
import random

import numpy as np
import pytest

from impressa.llm import substrings
from tests.llm import brute


def some_texts(n, sentence, seed=3):
    r = random.Random(seed)
    noise = lambda k: "".join(r.choices("abcdefghijklmnop ", k=k))
    out = [noise(r.randrange(0, 60)) + sentence + noise(r.randrange(0, 60)) for _ in range(n)]
    out += [t[r.randrange(0, 20) : len(t) - r.randrange(0, 20)] for t in out[: n // 4]]  # parts of others
    r.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("shared", [((2, 27),), ((2, 27), (2, 25)), ((2, 27), (2, 25), (3, 23)), ((2, 27), (2, 25), (2, 23))])
@pytest.mark.parametrize("sentence", ["all rights reserved worldwide by us.", "x" * 45, "a passage of over fifty bytes that is in every text, as it stands"])
def test_lots_give_the_same_runs(spark, monkeypatch, shared, sentence):
    monkeypatch.setattr(substrings, "_SHARED", shared)
    docs = some_texts(80, sentence)
    want = brute.substrings(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(df).collect()}
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in want.items()}


@pytest.mark.parametrize(("sentence", "level"), [("all rights reserved worldwide by us.", 2), ("all rights reserved worldwide by us, 46 bytes.", 3)])
def test_different_contexts_of_one_key_are_dealt_to_many_parts(sentence, level):
    docs = [t.encode() for t in some_texts(20_000, sentence).values()]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in docs])))
    a = substrings.Anchors(np.frombuffer(b"".join(docs), np.uint8), offsets)
    which, lo, hi = a.intervals(np.arange(len(a.at)))
    before = np.unique(a.key[which], return_counts=True)[1].max()
    assert before > 10_000  # one key that most documents have
    own, first, last, key = substrings.lots(a, which, lo, hi, np.full(len(which), level))
    size = last + substrings.LENGTH - first
    windows = np.concatenate([np.arange(x, y + 1) for x, y in zip(first, last, strict=True)])
    assert sorted(windows) == sorted(np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, hi, strict=True)]))
    texts = np.array([hash(a.sums[x + n] - a.sums[x]) for x, n in zip(first, size, strict=True)])
    different = np.unique(np.stack([key.astype(np.int64), texts, size]), axis=1)[0]
    assert np.unique(different, return_counts=True)[1].max() < 60

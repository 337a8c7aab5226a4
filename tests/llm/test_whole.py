"""Cases in which an operator once did less than its whole job."""

import math
import random
from collections import Counter, defaultdict

import pytest

from impressa.llm import queries
from tests.llm import brute


def trigram_scores(docs):
    """{doc_id: log10 probability} by interpolated modified Kneser-Ney of order 3 with every n-gram, learnt outside fold 2 of 7."""
    begin, end = object(), object()
    padded = {i: [begin, begin, *brute.words(t), end] for i, t in docs.items()}
    counts = {3: Counter(tuple(w[k : k + 3]) for i, w in padded.items() if brute.fold(i, 7) != 2 for k in range(len(w) - 2))}
    for n in (2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    after = defaultdict(list)
    for n in counts:
        for g, c in counts[n].items():
            after[n, g[:-1]].append(c)

    def discounts(own):
        n = Counter(own.values())
        if not n[1] or not n[2]:
            return [0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 2]
        return [0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))]

    d = {n: discounts(counts[n]) for n in counts}

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(counts[1]) + 1)
        found, c = after.get((len(g), g[:-1])), counts[len(g)][g]
        return (max(c - d[len(g)][min(c, 3)], 0) + sum(d[len(g)][min(x, 3)] for x in found) * lower) / sum(found) if found else lower

    return {i: sum(math.log10(p(tuple(w[k : k + 3]))) for k in range(len(w) - 2)) for i, w in padded.items()}


def test_op8_scores_by_all_trigrams(spark, tmp_path):
    r = random.Random(8)
    docs = {i: " ".join(r.choices("abcdefgh", k=r.randrange(40))) for i in range(60)} | {60: None, 61: "Seen Once here", 62: "Seen once here"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.score for x in queries.op8_lm_scoring(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(trigram_scores(docs), rel=1e-9)

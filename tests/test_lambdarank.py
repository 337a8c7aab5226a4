"""Ranking trees: gradients against all pairs, splits against a search, and a ranking that beats popularity."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from impressa.operators import features, lambdarank, metrics


def brute_lambdas(users: dict, k: int = 5) -> dict:
    """The same for {user: [(row_id, label, score)]}, pair by pair on one machine."""
    out = {}
    for rows in users.values():
        ranked = sorted(rows, key=lambda r: (-r[2], r[0]))
        rank = {r[0]: i for i, r in enumerate(ranked, 1)}
        out |= {r[0]: [0.0, 0.0] for r in rows}
        p = sum(r[1] for r in rows)
        ideal = sum(1 / math.log2(i + 1) for i in range(1, min(p, k) + 1))
        d = {i: 1 / math.log2(r + 1) if r <= k else 0.0 for i, r in rank.items()}
        for a in (r for r in rows if r[1]):
            for b in (r for r in rows if not r[1]):
                w = abs(d[a[0]] - d[b[0]]) / ideal
                q = 1 / (1 + math.exp(a[2] - b[2]))
                for i, s in ((a[0], -1), (b[0], 1)):
                    out[i][0] += s * q * w
                    out[i][1] += q * (1 - q) * w
    return out


ROWS = "row_id long, user_id long, label int, score double"


@pytest.mark.parametrize("k", [1, 5])
def test_gradients_are_those_of_all_pairs(spark, k):
    r = random.Random(k)
    users = {u: [(100 * u + i, int(r.random() < 0.4), r.choice([0.0, 0.5, r.gauss(0, 1)])) for i in range(r.choice([1, 2, 4, 9, 30]))] for u in range(25)}
    users[30] = [(5000 + i, 1, 0.1 * i) for i in range(4)]
    rows = spark.createDataFrame([(i, u, y, s) for u, own in users.items() for i, y, s in own], ROWS).repartition(3)
    want = brute_lambdas({u: own for u, own in users.items() if 0 < sum(x[1] for x in own) < len(own)}, k)
    for x in lambdarank.lambdas(rows, k).collect():
        assert (x.g, x.h) == pytest.approx(tuple(want.get(x.row_id, (0.0, 0.0))), abs=1e-12)


def test_splits_are_the_best(spark):
    rng = np.random.default_rng(0)
    bins, node, g, h = rng.integers(0, 8, (400, 3)), rng.integers(0, 2, 400), rng.normal(size=400), rng.random(400)
    rows = spark.createDataFrame([(int(n), [int(b) for b in x], float(a), float(c)) for n, x, a, c in zip(node, bins, g, h, strict=True)], "node long, bins array<int>, g double, h double").repartition(3)
    model = lambdarank.LambdaRank(["a", "b", "c"], bins=8, min_rows=5)
    got, total = model._splits(lambdarank.histogram(rows, 2, 3, 8).collect(), 2)
    for n in (0, 1):
        own = node == n
        assert total[:, n] == pytest.approx((g[own].sum(), h[own].sum()))

        def gain(f, b, own=own):
            left = own & (bins[:, f] <= b)
            right = own & ~left
            return -math.inf if min(left.sum(), right.sum()) < 5 else sum(g[x].sum() ** 2 / (h[x].sum() + 1) for x in (left, right))

        assert gain(*got[n]) == pytest.approx(max(gain(f, b) for f in range(3) for b in range(8)))


def table(spark, n, seed, first=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.random(), r.random()
        rows.append((first + i, i % 40, r.randrange(30), a, b if r.random() < 0.95 else None, r.random(), int(r.random() < (0.75 if a > 0.6 and b < 0.7 else 0.1))))
    return spark.createDataFrame(rows, "row_id long, user_id long, item_id long, a double, b double, c double, label int")


def test_trees_beat_popularity_on_valid(spark):
    train, valid = table(spark, 1500, 1), table(spark, 800, 2, 9000)
    model = lambdarank.LambdaRank(["a", "b", "c"], trees=4, depth=2, bins=16, lr=0.5).fit(train)
    assert len(model.trees) == 4 and all(len(t.leaves) == len(t.splits) + 1 for t in model.trees)
    own = metrics.ranking_metrics(model.predict(valid)).first()
    popular = metrics.ranking_metrics(features.popularity_scores(valid, train)).first()
    assert own.ndcg > popular.ndcg + 0.1 and own.gauc > popular.gauc + 0.1


def test_nothing_to_learn(spark):
    train = table(spark, 60, 1).withColumn("label", F.lit(0)).withColumn("a", F.lit(None).cast("double"))
    model = lambdarank.LambdaRank(["a"], trees=3).fit(train)
    assert {x.score for x in model.predict(train).collect()} == {0.0}
    with pytest.raises(ValueError, match="bins"):
        lambdarank.LambdaRank(["a"], bins=1)

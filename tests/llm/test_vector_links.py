"""Links of vectors: counts and roots of block pairs, and the plan around them."""

import numpy as np
import pytest

from impressa.llm import embeddings


def unit(v):
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def some_block(first, base, r, n=40):
    v = np.vstack([r.normal(size=(n, base.shape[1])), base + r.normal(size=base.shape) * 0.05])
    return unit(v), np.arange(first, first + len(v)), r.integers(1, 2**40, len(v))


@pytest.mark.parametrize("copies", [0, 1, 30])
@pytest.mark.parametrize("same", [False, True])
def test_links_of_a_block_pair(copies, same):
    r = np.random.default_rng(copies)
    base = np.repeat(r.normal(size=(1, 12)), copies, 0)
    a = some_block(100, base, r)
    b = a if same else some_block(500, base, r)
    ids, counts, roots = embeddings._links(a, b, same, 0.95)
    near = a[0] @ b[0].T >= 0.95
    if same:
        near[np.arange(len(near)), np.arange(len(near))] = False
    want = {int(a[1][i]): sum(int(b[2][j]) for j in np.flatnonzero(near[i])) for i in np.flatnonzero(near.any(1))}
    if not same:
        want |= {int(b[1][j]): sum(int(a[2][i]) for i in np.flatnonzero(near[:, j])) for j in np.flatnonzero(near.any(0))}
    assert dict(zip(ids.tolist(), counts.tolist(), strict=True)) == want and len(ids) == len(want)
    assert counts.dtype == np.int64 and bool(want) == (copies > (1 if same else 0))
    assert set(roots.tolist()) == ({int(ids.min())} if want else set())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_the_norm_is_computed_once_per_vector(spark, kind):
    df = spark.createDataFrame([(i, [1.0 + i, -2.0, 0.5 * i]) for i in range(5)], f"i long, embedding array<{kind}>")
    made = df.select("i", embeddings._unit("embedding").alias("u"))
    inside = str(made._jdf.queryExecution().optimizedPlan()).split("lambdafunction(")
    assert sum("aggregate(" in x for x in inside) == 1 and "/ SQRT(" not in "".join(inside)
    for x in made.collect():
        v = np.array([1.0 + x.i, -2.0, 0.5 * x.i])
        assert x.u == pytest.approx(v / np.sqrt((v * v).sum()), rel=1e-12)


def odd_rows(kind):
    r = np.random.default_rng(5)
    some = r.normal(size=(12, 4)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(some * 2)] + [(3, some[7]), (None, some[0]), (40, None), (41, [0.0, -0.0, 0.0, 0.0]), (42, [None, 1.0, 1.0, 1.0]), (43, []), (44, [float("nan"), 1.0, 1.0, 1.0]), (45, [-float("inf"), 1.0, 1.0, 1.0]), (46, [1.0, 0.0, 0.0, 0.0]), (47, [1.0, -0.0, 0.0, -0.0])]
    return rows, f"vec_id long, embedding array<{kind}>"


@pytest.mark.parametrize("kind", ["float", "double"])
def test_rows_meet_their_vector_by_hash_and_value(spark, kind, monkeypatch):
    df = spark.createDataFrame(*odd_rows(kind))
    found = embeddings.near_duplicates(df)
    assert "normaliz" not in str(found._jdf.queryExecution().optimizedPlan())  # floats as keys of a join are
    got = sorted(map(tuple, found.collect()), key=str)
    both = {i: c for i, _, c, _ in got}
    assert len(got) == 34 and all(both[i] == both[i + 12] for i in range(12)) and both[46] == both[47] == 46
    assert {r for r in got if r[0] is None or r[0] in range(40, 46)} == {(None, 0, None, True)} | {(i, 0, i, True) for i in range(40, 46)}
    real = embeddings.F.xxhash64
    monkeypatch.setattr(embeddings.F, "xxhash64", lambda *c: real(*c) % 3)  # equal hashes of unequal vectors
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str) == got

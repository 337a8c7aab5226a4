"""The manifest against hashing on one machine."""

import hashlib
import random
import zlib

import pytest

from impressa.llm import manifest, queries


def digest(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, siblings left and right of each node, level by level)"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            first = a // 3 * 3
            paths[i].append(("".join(nodes[first:a]), "".join(nodes[a + 1 : first + 3])))
        nodes, at = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)], [a // 3 for a in at]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {k: tree([x[2] for x in sorted(by[k])]) for k in keys}
    root, over = tree([trees[k][0] for k in keys]) if keys else (None, [])
    out = []
    for k, above in zip(keys, over, strict=True):
        for (_, _, h, r), own in zip(sorted(by[k]), trees[k][1], strict=True):
            path, folded = own + above, h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                folded = leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in path:
                folded = digest(left, folded, right)
            out.append((r[0], h, trees[k][0], root, digest(*(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def made(sizes, seed=1):
    r, rows = random.Random(seed), []
    for source, n in sizes:
        rows += [(len(rows) + k, source, r.choice(["en", None, ""]), r.choice([None, 5]), r.choice(["é\na", "x", None, "", "\n\nzz"])) for k in range(n)]
    r.shuffle(rows)
    return rows


CASES = {
    "empty": [],
    "one": made([("a", 1)]),
    "null source": made([(None, 1), ("", 4), ("é", 10), ("z", 28)]),
    "hot source": made([("hot", 3 * 729 + 1), ("b", 729), ("c", 730), (None, 728), ("e", 9)]),
    "more than 81 sources": made([(f"s{i}", 1 + i % 3) for i in range(100)]),
    "repeats": made([("a", 5)]) * 3 + [(None, None, None, None, None)] * 4 + [(None, "a", "x", 1, "q\n")] * 2 + [(3, "a", None, None, "t")],
    "long": [(1, "a", "en", 9, "é\n" * 400_000), (2, "a", "en", 1, "x")],
}


@pytest.mark.parametrize("name", CASES)
def test_manifest(spark, tmp_path, name):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in CASES[name]], "doc_id long, source string, lang string, n_chars long, text string, leaf string, p int, key string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(CASES[name])


def test_joins_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "MAX_BROADCAST", 0)
    test_manifest(spark, tmp_path, "hot source")

"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from impressa.llm import periods, queries


def brute_runs(w, least=12):
    n, out = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            s = i
            while i < n - p and w[i] == w[i + p]:
                i += 1
            size = i - s + p
            own = w[s : s + size]
            if i > s and size >= max(least, 2 * p) and not any(all(own[k] == own[k + q] for k in range(size - q)) for q in range(1, p)):
                out.add((s, size, p))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digests = ["".join(f"{s},{size},{q}\n" for s, size, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone)]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in digests))


def test_runs_of_sequences():
    r = random.Random(7)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 150:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for _ in range(400):
        n, k = r.randrange(0, 100), r.choice([1, 2, 2, 3, 6])
        w = fibonacci[-1][:n] if r.random() < 0.1 else [r.randrange(k) for _ in range(n)]
        if n > 10 and r.random() < 0.6:
            q, a = r.randrange(1, 9), r.randrange(n)
            for i in range(a + q, r.randrange(a, n)):
                w[i] = w[i - q]
        assert periods.runs_of(np.array(w, np.int32)) == brute_runs(w)


def test_probes_in_many_slices():
    w = np.arange(300_000)
    w[5:200_000] = 5 + (w[5:200_000] - 5) % 70_000
    w[250_000:] = 7
    assert periods.runs_of(w) == [(5, 199_995, 70_000), (250_000, 50_000, 1)]


def test_query_rows(spark, tmp_path):
    r = random.Random(3)
    vocabulary = ["a", "B", "b", "é", "x y", "long" * 9, "..."]
    rows = [(i, r.choice([" ", "\t", "\x0b\r\n", "  "]).join(r.choices(vocabulary[: r.randrange(1, 8)], k=r.randrange(0, 70)))) for i in range(300)]
    rows += [(1001, None), (1002, ""), (1003, " \n "), (None, None), (None, "a " * 30), (1004, "w " * 1_500), (1004, "w " * 1_500), (-5, "a b " * 9)]
    docs = spark.createDataFrame([(*x, 1, "n", 0) for x in rows], "doc_id long, text string, runs int, collapsed string, n_words int").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_row(*x) for x in rows), key=str)
    assert any(x.n_runs > 1 for x in got.collect())


def test_empty_table_and_own_columns(spark):
    none = spark.createDataFrame([], "key long, body string")
    assert periods.detect(none, "key", "body").count() == 0
    found = periods.detect(none.union(spark.createDataFrame([(1, "x " * 12)], none.schema)), "key", "body").first()
    assert found.n_words == 12 and found.collapsed == "x" and [tuple(x) for x in found.runs] == [(0, 12, 1)]
    planted = spark.createDataFrame([("one two three",)], "t string").select(periods.with_periodic_tail("t", F.lit(10).cast("long")).alias("t")).first().t
    assert planted == "one two two"

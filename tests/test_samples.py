"""Samples against plain Python."""

import zlib

import pytest

from pyspark.sql import functions as F

from impressa.operators import features, sampling


def test_holdout_is_zlib_crc32(spark):
    users = [0, 1, 7, 12345, -3, 10**12]
    got = {r.u: r.h for r in spark.createDataFrame([(u,) for u in users], "u long").withColumn("h", sampling.in_holdout(F.col("u"), 0.2)).collect()}
    assert got == {u: zlib.crc32(str(u).encode()) % 10_000 < 2_000 for u in users}


def test_placed_with_ties_nulls_and_weights(spark):
    rows = [(i, (i * 7) % 5 if i % 11 else None, i % 3 + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k int, w int").repartition(5)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    want, total = {}, 0
    for place, (i, _, w) in enumerate(order):
        want[i] = (place, total)
        total += w
    got = {r.id: r.p for r in features.placed(df, "k", ["id"], "p").collect()}
    assert got == {i: p for i, (p, _) in want.items()}
    assert {r.id: r.p for r in features.placed(df, "k", ["id"], "p", "w").collect()} == {i: t for i, (_, t) in want.items()}
    assert features.placed(df.limit(0), "k", ["id"], "p").count() == 0


def test_quantile_edges_interpolate(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 9, 4)] + [(None,), (float("nan"),)], "v double")
    assert features.quantile_edges(df, "v", 4) == [1.0, 4.0, 5.0]
    assert features.quantile_edges(df, "v", 3) == pytest.approx([2.0, 4 + 2 / 3])
    assert features.quantile_edges(df.limit(0), "v", 3) == []

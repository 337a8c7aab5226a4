"""Operators against brute force and closed forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from impressa.operators import features, ledger, metrics, sampling
from impressa.sources import impressions, ledgers, predictions
from impressa.streaming import events


def brute(rows, k=5):
    by = {}
    for u, y, s, i in rows:
        by.setdefault(u, []).append((y, s, i))
    num = den = 0.0
    nd = []
    for items in by.values():
        pos, neg = [s for y, s, _ in items if y], [s for y, s, _ in items if not y]
        if pos and neg:
            auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
            num, den = num + len(pos) * auc, den + len(pos)
        order = sorted(items, key=lambda x: (-x[1], x[2]))
        dcg = sum((2 ** x[0] - 1) / math.log2(j + 2) for j, x in enumerate(order[:k]))
        best = sum((2**y - 1) / math.log2(j + 2) for j, y in enumerate(sorted((x[0] for x in items), reverse=True)[:k]))
        nd.append(dcg / best if best else 0.0)
    return (num / den if den else 0.5), (sum(nd) / len(nd) if nd else 0.0)


@pytest.mark.parametrize("seed", [0, 1])
def test_ranking_metrics(spark, seed):
    r = random.Random(seed)
    rows = [(f"u{r.randrange(9)}", int(r.random() < 0.3), float(r.randrange(4)), i) for i in range(120)] + [("one", 1, 0.5, 900), ("none", 0, 0.5, 901)]
    got = metrics.ranking_metrics(spark.createDataFrame(rows, "user_id string, label int, score double, row_id long")).first()
    gauc, ndcg = brute(rows)
    assert got.gauc == pytest.approx(gauc) and got.ndcg == pytest.approx(ndcg) and got.primary_score == pytest.approx((gauc + ndcg) / 2)


def test_ranking_metrics_without_rows_or_mixed_users(spark):
    empty = spark.createDataFrame([], "user_id string, label int, score double, row_id long")
    assert metrics.ranking_metrics(empty).first().gauc == 0.5
    assert metrics.ranking_metrics(spark.createDataFrame([("a", 1, 1.0, 1)], empty.schema)).first().gauc == 0.5


def test_csv_semantics(spark, tmp_path):
    (tmp_path / "log.csv").write_text("﻿date,user_id,video_id,tab,duration_ms,long_view\n20220408,u,v1,1,5.0,0\n\n20220409,u,v2,1,5.0,\n20220410,u,v3,1,5.0,0.0\n20220430,u,v1,1,5.0,1\n20230101,u,v1,1,5,1\n")
    (tmp_path / "dim.csv").write_text("video_id,author_id\nv1,a\nv1,b\nv2,\n")
    got = impressions.read_logs(spark, [str(tmp_path / "log.csv")], str(tmp_path / "dim.csv"), include_test=True)
    rows = {(r.date, r.video_id): (r.split, r.author_id, r.label) for r in got.collect()}
    assert rows == {(20220408, "v1"): ("train", "b", 0), (20220409, "v2"): ("train", "", 1), (20220410, "v3"): ("train", "UNK", 1), (20220430, "v1"): ("test", "b", None)}
    with pytest.raises(ValueError):
        impressions.read_dimension(spark, str(tmp_path / "log.csv"))


def test_stratified_counts_are_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    for fraction in (0.001, 0.15, 0.5, 1.0):
        got = {r.label: r["count"] for r in sampling.stratified(df, fraction, sampling.hash_order(3, "row_id")).groupBy("label").count().collect()}
        assert got == {0: max(1, round(900 * fraction)), 1: max(1, round(100 * fraction))}
    first = sampling.stratified(df, 0.15, "row_id").where("label = 0").agg(F.max("row_id")).first()[0]
    assert first == sorted(i for i in range(1000) if i % 10)[134]


def test_holdout_parts_are_disjoint(spark):
    df = spark.range(500).select(F.col("id").alias("user_id"))
    inside = sampling.in_holdout(F.col("user_id"), 0.2)
    n = df.where(inside).count()
    assert 75 <= n <= 125 and n + df.where(~inside).count() == 500


def test_out_of_fold_never_sees_its_own_label(spark):
    rows = [(i, "a" if i == 0 else "b", int(i == 0)) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, item string, label int")
    got = features.target_encoding_oof(df, "item", F.col("row_id") % 5, smoothing=0.0).where("item = 'a'").first()
    assert got.encoding == pytest.approx(1 / 20)


def test_bucket_conventions(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (None,), (float("nan"),)], "v double")
    got = [tuple(r) for r in df.select(features.bucket_left(F.col("v"), [1.0, 2.0, 2.0]), features.bucket_right(F.col("v"), [1.0, 2.0, 2.0])).collect()]
    assert got[:3] == [(0, 2), (1, 3), (3, 3)] and got[3][1] == 0 and got[4][1] == 0


def test_predictions(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "p.npy", np.array([0.5, 1.0]))
    assert [r.score for r in predictions.read_scores(spark, str(tmp_path / "p.npy")).orderBy("row_id").collect()] == [0.5, 1.0]
    (tmp_path / "p.csv").write_text("row_id,prediction\n0,0.5\n1,x\n")
    rows = predictions.read_scores(spark, str(tmp_path / "p.csv"))
    assert predictions.health(rows, 2).first().asDict() == {"pred_rows": 2, "nonfinite": 1, "min_score": 0.5, "max_score": 0.5, "distinct_scores": 1, "rows_match": True}
    sub = spark.createDataFrame([(1, "u", "v", 0.25), (0, "u", "v", 1e-7)], "row_id long, user_id string, video_id string, score double")
    predictions.write_submission(sub, str(tmp_path / "s"))
    assert [r.row_id for r in predictions.read_submission(spark, str(tmp_path / "s")).orderBy("row_id").collect()] == [0, 1]


def test_clamped_fold_is_ordered(spark):
    df = spark.createDataFrame([("a", 2, -0.1, 0.9), ("a", 1, 0.15, 0.9)], "card string, seq int, delta double, prior double")
    assert ledger.trust(df).first().prior == pytest.approx(0.85)


def test_stream_reads_new_files_once(spark, tmp_path):
    schema = "kind string, seq long, text string"
    for batch in ([("a", 1, "x")], [("a", 2, "y"), ("b", 3, "z")]):
        ledgers.append_jsonl(spark.createDataFrame(batch, schema), str(tmp_path / "log"))
        events.drain(events.tail(spark, str(tmp_path / "log"), schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.kind: r.text for r in events.assemble_text(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"a": "xy", "b": "z"}

"""Text rules, ledger files, prediction files and plug-ins against plain values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from impressa.functions import text as tx
from impressa.operators import ledger, models, sampling
from impressa.sources import impressions, ledgers, predictions
from impressa.streaming import events


def test_text_rules(spark):
    rows = ["gauc fell", "a\nb\nc", "0.7", "1e9", "none", "modules/x.py", "modules/../x.py", "other/x.py", "modules", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", tx.mentions(F.col("t"), ["gauc", "auc"]).alias("m"), tx.tail_lines(F.col("t"), 2, 3).alias("tail"), tx.clamp(F.col("t"), 0.1, 10.0, 0.5).alias("c"), tx.safe_path(F.col("t"), ["modules", "conf/"]).alias("p")).collect()
    by = {rows[r.i]: r for r in got}
    assert by["gauc fell"].m and not by["none"].m
    assert by["a\nb\nc"].tail == "b\nc" and by["gauc fell"].tail == "ell"
    assert (by["0.7"].c, by["1e9"].c, by["none"].c, by[None].c) == (0.7, 10.0, 0.5, 0.5)
    assert [t for t in rows if by[t].p] == ["modules/x.py"]


def test_ledger_files(spark, tmp_path):
    one = tmp_path / "one.json"
    one.write_text(json.dumps({"a": 1, "b": {"c": "x"}}, indent=2), encoding="utf-8")
    assert ledgers.read_document(spark, str(one)).first().b.c == "x"
    state = str(tmp_path / "state")
    for number, value in ((1, "a"), (2, "b"), (1, "c")):
        ledgers.write_snapshot(spark.createDataFrame([(value,)], "v string"), state, number)
    assert {(r.round, r.v) for r in spark.read.json(state).collect()} == {(1, "c"), (2, "b")}
    assert json.loads(ledgers.plain_json({"n": np.int64(3), "v": np.array([1.5, 2.0]), "t": "é"})) == {"n": 3, "v": [1.5, 2.0], "t": "é"}
    pytest.importorskip("yaml")
    (tmp_path / "cards.yaml").write_text("- {id: c1, prior: 0.5}\n- {id: c2}\n", encoding="utf-8")
    assert [tuple(r) for r in ledgers.read_yaml(spark, str(tmp_path / "cards.yaml"), "id string, prior double").collect()] == [("c1", 0.5), ("c2", None)]


def test_events_are_listed_fields_and_never_raise(spark, tmp_path):
    df = spark.createDataFrame([("10:00:00", "round", 3, "secret")], "ts string, type string, round int, key string")
    log = str(tmp_path / "log")
    assert events.emit(df, log) and events.emit(df, log)
    assert [r.asDict() for r in spark.read.json(log).collect()] == 2 * [{"ts": "10:00:00", "type": "round", "round": 3}]
    (tmp_path / "file").write_text("x")
    assert not events.emit(df, str(tmp_path / "file" / "log")) and not events.emit(df, None)


def test_prediction_template_and_preview(spark, tmp_path):
    assert [tuple(r) for r in predictions.template(spark.range(2).withColumnRenamed("id", "row_id")).orderBy("row_id").collect()] == [(0, 0.0), (1, 0.0)]
    (tmp_path / "log.csv").write_text("a,b\n" + "".join(f"{i},{i}\n" for i in range(9)))
    assert impressions.preview(spark, str(tmp_path / "log.csv"), 4).count() == 4


def test_folds_and_digests(spark):
    rows = spark.range(2000).withColumn("score", F.col("id") * 0.5).withColumnRenamed("id", "row_id")
    folds = {r.f: r["count"] for r in rows.groupBy(sampling.fold_of(F.col("row_id"), 5, 1).alias("f")).count().collect()}
    assert set(folds) == set(range(5)) and all(300 < n < 500 for n in folds.values())
    digest = ledger.score_digest(rows).first()
    assert ledger.score_digest(rows.repartition(3).orderBy(F.desc("row_id"))).first() == digest and digest.n == 2000
    assert ledger.score_digest(rows.withColumn("score", F.when(F.col("row_id") == 7, 9.0).otherwise(F.col("score")))).first().digest != digest.digest


def test_feature_ops_do_not_see_labels(spark):
    df = spark.createDataFrame([(i, f"v{i % 3}", i % 2) for i in range(9)], "row_id long, item string, label int")
    op = models.FrequencyOp("item")
    op.fit(df)
    assert {(r.row_id, r.label, r.n) for r in models.transform_without_label(op, df).collect()} == {(i, i % 2, 3) for i in range(9)}

    class Peeks(models.FrequencyOp):
        def transform(self, rows):
            return rows.withColumn("n", F.col("label"))

    class Drops(models.FrequencyOp):
        def transform(self, rows):
            return rows.where("row_id > 3")

    with pytest.raises(Exception, match="label"):
        models.transform_without_label(Peeks("item"), df)
    with pytest.raises(ValueError, match="keep the rows"):
        models.transform_without_label(Drops("item"), df)


def test_fm_keeps_the_best_state(spark, monkeypatch):
    seen = []
    scores = iter([0.5, 0.7, 0.6, 0.65, 0.9])

    class Fake:
        def __init__(self, **k):
            self.epochs = k["maxIter"]

        def fit(self, rows):
            seen.append(self.epochs)
            return self.epochs

    monkeypatch.setattr(models, "FMClassifier", Fake)
    monkeypatch.setattr(models.FMTrainer, "_pipeline", lambda self, train: (type("E", (), {"transform": staticmethod(lambda x: x)}),) * 2)
    monkeypatch.setattr(models.FMTrainer, "predict", lambda self, model, rows: rows)
    monkeypatch.setattr(models.metrics, "ranking_metrics", lambda rows: type("M", (), {"first": staticmethod(lambda: type("R", (), {"primary_score": next(scores)}))}))
    assert models.FMTrainer(["f"]).fit("train", "valid", 0, {"epochs": 16})[2] == 2  # 0.7, then two without a gain
    assert seen == [1, 2, 4, 8]
    assert models.FMTrainer(["f"]).fit("train", None, 0, {"epochs": 7})[2] == 7

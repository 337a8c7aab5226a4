"""Feature plug-ins: declared columns, out-of-fold train, blind elsewhere, kept rows, saved and loaded; rules of the sessions."""

import pytest
from pyspark.sql import functions as F

from impressa.operators import features, models, plugins, sessions


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"v{i % 5}" if i % 11 else None, i % 3, int(i % 4 == 0)) for i in range(120)]
    train = spark.createDataFrame(rows[:80], "row_id long, item string, other int, label int")
    return train, spark.createDataFrame([*rows[80:], (500, "new", 1, 1)], train.schema)


def test_fit_on_train_and_new_columns(tables):
    train, valid = tables
    ops = [plugins.TargetEncoder(field="item", smoothing=3.0, folds=4), plugins.FrequencyEncoder(field="item", output="n")]
    assert [op.needs() for op in ops] == [["item"], ["item"]]
    got, (other,), new, fitted = plugins.apply(ops, train, [valid])
    assert new == ["encoding", "n"] and got.count() == 80 and other.count() == 41 and set(other.columns) == {*valid.columns, *new}
    rows = train.collect()
    mean = sum(r.label for r in rows) / len(rows)
    for r in other.collect():
        own = [x.label for x in rows if x.item == r["item"] and r["item"] is not None]
        assert r.encoding == pytest.approx((sum(own) + 3 * mean) / (len(own) + 3)) and r.n == len(own)
    assert {r.row_id: r.label for r in other.collect()} == {r.row_id: r.label for r in valid.collect()}
    want = features.target_encoding_oof(train, "item", F.pmod(F.xxhash64("row_id"), F.lit(4)), 3.0)
    assert {r.row_id: r.encoding for r in got.collect()} == pytest.approx({r.row_id: r.encoding for r in want.collect()})


def test_models_are_saved_and_loaded(tables, tmp_path):
    train, valid = tables
    for op in (plugins.TargetEncoder(field="item", output="e", smoothing=2.0), plugins.FrequencyEncoder(field="item", output="e")):
        model = op.fit(train)
        where = str(tmp_path / type(op).__name__)
        model.save(where)
        again = type(model).load(where)
        assert again.needs() == ["item"] and again.uid == model.uid
        assert sorted(map(str, again.transform(valid.drop("label")).collect())) == sorted(map(str, model.transform(valid.drop("label")).collect()))
        op.save(f"{where}-op")
        assert type(op).load(f"{where}-op").needs() == ["item"]


class Fake:
    def __init__(self, run):
        self.run, self.seen = run, None

    def needs(self):
        return ["item", "label"]

    def transform(self, rows):
        self.seen = rows.columns
        return self.run(rows)


@pytest.mark.parametrize("run", [lambda r: r.where("row_id <> 81"), lambda r: r.union(r.where("row_id = 81")), lambda r: r.withColumn("row_id", F.col("row_id") + 1), lambda r: r.withColumn("row_id", F.when(F.col("row_id") > 85, F.col("row_id")))])
def test_changed_rows_are_refused(tables, run):
    _, valid = tables
    with pytest.raises(ValueError, match="keep the rows"):
        plugins.blind(Fake(lambda r: run(r).withColumn("x", F.lit(1))), valid, ["item"])
    with pytest.raises(ValueError, match="keep the rows"):
        models.transform_without_label(Fake(run), valid)


def test_an_op_never_sees_labels_or_columns_it_did_not_ask_for(tables):
    _, valid = tables
    op = Fake(lambda r: r.withColumn("x", F.lit(0)))
    assert plugins.blind(op, valid, op.needs()).where("x = 0").count() == 41 and op.seen == ["row_id", "item"]


def test_danger_and_rules(spark):
    cards = spark.createDataFrame([(i, 0.9, 0.7) for i in range(6)] + [(6, 0.9, 0.8)], "run int, train_primary double, valid_primary double")
    found = [(0, "memorising", 0.7), (1, "mismatch", 0.9), (1, "memorising", 0.1), (2, "drift", 0.9), (3, "memorising", 0.69), (4, "memorising", 0.2), (4, "slow", 1.0)]
    got = sessions.danger_gate(cards, spark.createDataFrame(found, "run int, symptom string, severity double"))
    assert sorted(r.run for r in got.collect()) == [2, 3, 4, 5]
    base = dict(low_gauc=0.6, low_share=0.3, high_gauc=0.65, gauc=0.6, ndcg=0.6, prev_gauc=None, prev_ndcg=None, seen_gauc=0.6, unseen_gauc=0.6, falls=False, mixed_share=0.9, best_epoch=1, epochs=5, seconds=1.0, budget=100.0, sd=None, rows_match=True, nonfinite=0, distinct_scores=9)
    rows = [dict(run=1, train_primary=0.58, valid_primary=0.53, low_band=None, primary_band=None, loss="bce", features=["n"], **base), dict(run=2, train_primary=0.58, valid_primary=0.53, low_band=0.06, primary_band=0.06, loss="bpr", features=["recent_items"], **base)]
    kinds = {"run": "int", "falls": "boolean", "rows_match": "boolean", "best_epoch": "int", "epochs": "int", "nonfinite": "int", "distinct_scores": "int", "loss": "string", "features": "array<string>"}
    names = list(rows[0])
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))
    got = sorted((r.run, r.symptom) for r in sessions.symptom_rules(frame).collect())
    assert got == [(1, s) for s in ("cold_items", "drift", "memorising", "pointwise_loss", "unused_history")]

"""Minibatch training against one machine, early stop, resumption, and scores by arrays and by join."""

import math
import pickle
import random

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from impressa.operators import fm

ROWS = "row_id long, user_id long, a_code int, b_code int, label int"


def rows(spark, n, seed=0, offset=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b = r.randrange(12), r.randrange(9)
        out.append((offset + i, i % 20, a, b, int(r.random() < (0.9 if (a + b) % 3 == 0 else 0.2))))
    return spark.createDataFrame(out, ROWS)


def plain(table, trainer, batches, sizes, epochs):
    """The same training in one process, written out row by row."""
    state = fm.State.new(sum(sizes), trainer.factors, trainer.seed)
    p = np.column_stack([state.w, state.v])
    m, s, b, step = np.zeros_like(p), np.zeros_like(p), 0.0, 0
    for epoch in range(1, epochs + 1):
        for k in np.random.default_rng((trainer.seed, epoch)).permutation(batches).tolist():
            own = [r for r in table if r.batch == k]
            if not own:
                continue
            g, gb = np.zeros_like(p), 0.0
            for r in own:
                at = [min(r.a_code, sizes[0] - 1), sizes[0] + min(r.b_code, sizes[1] - 1)]
                total = p[at, 1:].sum(axis=0)
                z = b + p[at, 0].sum() + ((total**2 - (p[at, 1:] ** 2).sum(axis=0)) / 2).sum()
                d = (1 / (1 + math.exp(-z)) - r.label) / len(own)
                gb += d
                for i in at:
                    g[i, 0] += d
                    g[i, 1:] += d * (total - p[i, 1:])
            g += trainer.l2 * p
            step += 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            p = p - trainer.lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            b -= trainer.lr * gb
    return p, b


def test_training_is_that_of_one_machine(spark):
    train = rows(spark, 300)
    trainer = fm.MinibatchFM(["a_code", "b_code"], factors=3, lr=0.05, batch_rows=70, epochs=3, seed=5)
    state = trainer.fit(train)
    table = train.withColumn("batch", F.pmod(F.xxhash64("row_id", F.lit(5)), F.lit(5))).collect()
    p, b = plain(table, trainer, 5, [13, 10], 3)
    assert np.allclose(np.column_stack([state.w, state.v]), p, atol=1e-12) and abs(state.b - b) < 1e-12
    assert state.epoch == 3 and state.step == 15 and trainer.losses[-1] < trainer.losses[0]


def test_a_minibatch_may_span_partitions(spark, monkeypatch):
    train = rows(spark, 300)
    one = fm.MinibatchFM(["a_code", "b_code"], factors=3, batch_rows=150, epochs=2).fit(train)
    monkeypatch.setattr(fm, "_TASK_ROWS", 40)
    many = fm.MinibatchFM(["a_code", "b_code"], factors=3, batch_rows=150, epochs=2).fit(train)
    assert np.allclose(one.v, many.v, atol=1e-12) and np.allclose(one.w, many.w, atol=1e-12)


def test_best_state_is_kept_and_training_stops(spark):
    train, valid = rows(spark, 400), rows(spark, 200, 1, 1000)
    trainer = fm.MinibatchFM(["a_code", "b_code"], factors=4, lr=0.3, batch_rows=100, epochs=40, patience=2)
    state = trainer.fit(train, valid)
    assert len(trainer.losses) < 40 and state.epoch == len(trainer.losses) - 2
    from impressa.operators import metrics

    assert metrics.ranking_metrics(trainer.predict(state, valid)).first().primary_score == pytest.approx(state.primary, abs=1e-12)
    assert state.primary > metrics.ranking_metrics(valid.withColumn("score", F.lit(0.0))).first().primary_score


def test_a_fit_goes_on_from_its_folder(spark, tmp_path):
    train, valid = rows(spark, 200), rows(spark, 100, 1, 1000)

    def trainer(epochs):
        return fm.MinibatchFM(["a_code", "b_code"], factors=2, lr=0.05, batch_rows=60, epochs=epochs, patience=9)

    whole = trainer(4).fit(train, valid)
    trainer(2).fit(train, valid, folder=str(tmp_path))
    second = trainer(4)
    again = second.fit(train, valid, folder=str(tmp_path))
    assert len(second.losses) == 2 and again.epoch == whole.epoch and np.allclose(again.v, whole.v, atol=1e-12)


def test_unknown_codes_nulls_and_limits(spark):
    train = spark.createDataFrame([(1, 1, 0, None, 1), (2, 1, None, 1, 0), (3, 2, 1, 0, 1)], ROWS)
    trainer = fm.MinibatchFM(["a_code", "b_code"], factors=2, batch_rows=2, epochs=1)
    state = trainer.fit(train)
    scored = {r.row_id: r.score for r in trainer.predict(state, spark.createDataFrame([(1, 1, 99, -4, None), (2, 1, None, None, None)], ROWS)).collect()}
    assert scored[1] == scored[2] and math.isfinite(scored[1])
    with pytest.raises(ValueError, match="max_parameters"):
        fm.MinibatchFM(["a_code"], max_parameters=10).fit(train)
    assert fm.MinibatchFM(["a_code", "b_code"], epochs=2).fit(train.limit(0)).step == 0


@pytest.mark.parametrize("limit", [fm.MAX_PARAMETERS, 0])
def test_scores_from_a_table(spark, limit):
    parameters = spark.createDataFrame([("a", "1", 0.5, [1.0, 2.0]), ("b", "x", 0.25, [3.0, -1.0]), ("a", "2", -1.0, [0.5, 0.5])], "field string, value string, w double, v array<double>")
    given = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (3, None, None), (4, 2, "x")], "row_id long, a int, b string")
    got = {r.row_id: r.score for r in fm.scores(given, ["a", "b"], parameters, 0.1, max_parameters=limit).collect()}
    assert got == pytest.approx({1: 0.1 + 0.75 + 1.0, 2: 0.1 - 1.0, 3: 0.1, 4: 0.1 - 0.75 + 1.0})


def test_shards_do_not_change_the_training(spark, monkeypatch):
    train, valid = rows(spark, 300), rows(spark, 100, 1, 1000)

    def fit():
        return fm.MinibatchFM(["a_code", "b_code"], factors=3, lr=0.05, batch_rows=150, epochs=2).fit(train, valid)

    one = fit()
    monkeypatch.setattr(fm, "_SHARD_PARAMETERS", 20)
    monkeypatch.setattr(fm, "_TASK_ROWS", 40)
    many = fit()
    for a, b in ((one.v, many.v), (one.w, many.w), (one.first, many.first), (one.second, many.second), (one.primary, many.primary), (one.b, many.b)):
        assert np.allclose(a, b, atol=1e-12)


def test_steps_send_the_driver_no_gradients(spark, monkeypatch):
    sent, run = [], SparkContext.runJob

    def noted(*args, **kw):
        out = run(*args, **kw)
        sent.append(len(pickle.dumps(out)))
        return out

    monkeypatch.setattr(SparkContext, "runJob", noted)
    train = spark.range(600).select(F.col("id").alias("row_id"), F.col("id").alias("user_id"), F.col("id").cast("int").alias("a_code"), (F.col("id") % 5).cast("int").alias("b_code"), (F.col("id") % 2).cast("int").alias("label"))
    state = fm.MinibatchFM(["a_code", "b_code"], batch_rows=300, epochs=1).fit(train, train)
    assert state.step == 2 and max(sent, default=0) < 2_000

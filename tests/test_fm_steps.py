"""Steps of a fit inside one stage: jobs, shares of the tasks, several tasks against one machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from impressa.operators import fm
from tests.test_fm import plain, rows


def test_jobs_do_not_grow_with_minibatches(spark):
    train, tracker = rows(spark, 240).localCheckpoint(), spark.sparkContext.statusTracker()

    def stages(batch_rows):
        group = f"fm-{batch_rows}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            state = fm.MinibatchFM(["a_code", "b_code"], factors=2, batch_rows=batch_rows, epochs=1).fit(train)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return state.step, sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group))

    (few, a), (many, b) = stages(240), stages(6)
    assert few == 1 and many > 30 and 0 < b <= a + 5


@pytest.mark.parametrize("tasks", [1, 3])
def test_many_steps_of_several_tasks_are_those_of_one_machine(spark, monkeypatch, tasks):
    monkeypatch.setattr(fm, "_SHARD_PARAMETERS", 1)
    train = rows(spark, 300)
    trainer = fm.MinibatchFM(["a_code", "b_code"], factors=3, lr=0.05, batch_rows=10, epochs=2, seed=5, tasks=tasks)
    state = trainer.fit(train)
    table = train.withColumn("batch", F.pmod(F.xxhash64("row_id", F.lit(5)), F.lit(30))).collect()
    p, b = plain(table, trainer, 30, [13, 10], 2)
    assert np.allclose(np.column_stack([state.w, state.v]), p, atol=1e-12) and abs(state.b - b) < 1e-12
    assert state.step == 2 * len({r.batch for r in table})


def test_tasks_get_even_shares(spark):
    trainer = fm.MinibatchFM(["a_code"])
    trainer.sizes = [5]
    train = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 4).cast("int").alias("a_code"), F.lit(1).alias("label"))
    n = [r["count"] for r in trainer._deal(train, "row_id", 344, 4).groupBy("piece").count().collect()]
    assert len(n) == 4 and max(n) < 1.1 * min(n)

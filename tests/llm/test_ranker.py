"""The quality ranker: its cut against brute force, its preferences on held-out labels."""

import os

import numpy as np
import pytest

from impressa.llm import quality, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(6))
def test_cut_has_the_fewest_errors_of_all_quantiles(seed):
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, 80)
    y[:2] = 0, 1
    raw = np.round(r.normal(y * 1.5, 1), 1)  # with ties

    def errors(c):
        return sum(int(v >= c) != t for v, t in zip(raw, y, strict=True))

    assert errors(quality._quantile_cut(raw, y)) == min(errors(c) for c in np.quantile(raw, np.linspace(0, 1, 1001)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_preferences(spark):
    got = queries.op10_quality_classifier(spark, SF).where("held_out").toPandas()
    held = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas().dropna(subset=["quality"]), on="doc_id")
    good, bad = (held[held.quality == k].score.to_numpy() for k in (1, 0))
    assert len(good) > 5 and len(bad) > 5
    wins = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    assert wins > 0.95  # a constant score has 0.5
    assert (held.predicted[held.quality == 1] == 1).mean() > 0.9 and (held.predicted[held.quality == 0] == 0).mean() > 0.9
    assert ((held.score >= quality.CUT) == (held.predicted == 1)).all()

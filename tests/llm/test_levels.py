"""Document-frequency levels keep frequent keys apart however many keys there are."""

import numpy as np
import pytest

from impressa.llm.sharing import frequency_levels, levels_of


@pytest.mark.parametrize("partitions", ["4", "300"])
def test_levels_do_not_fill_up(spark, partitions):
    r = np.random.default_rng(3)
    pool, hot = r.integers(0, 1 << 64, 5000, np.uint64), np.uint64(0xABCDEF0123456789)
    docs = [np.append(pool[r.permutation(5000)[:200]], hot) for _ in range(300)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.createDataFrame([(i, [int(x) for x in d.view(np.int64)]) for i, d in enumerate(docs)], "id long, keys array<long>").repartition(3)

        def keys_of(batch):
            sizes = [len(x) for x in batch.column("keys").to_pylist()]
            yield np.repeat(np.arange(batch.num_rows), sizes), batch.column("keys").flatten().to_numpy().view(np.uint64)

        levels = frequency_levels(rows, keys_of, ((2, 17), (4, 14))).value
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    held = levels_of(levels, pool)
    assert levels_of(levels, np.array([hot]))[0] == 2  # in every document
    assert (held >= 1).all()  # never too low: each is in two documents or more
    assert (held == 2).mean() < 0.3  # nearly all are in four or more, and so would fill the second bitmap
    free = r.integers(0, 1 << 64, 5000, np.uint64)
    assert (levels_of(levels, free) == 0).mean() > 0.9

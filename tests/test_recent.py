"""recent_items holds a bounded number of a user's earlier rows."""

import random

from impressa.operators import features


def test_recent_items_are_bounded(spark):
    r = random.Random(6)
    rows = [(i, r.choice((None, 1, 2, 3)), r.randrange(12), r.choice((None, "a", "b", "c", "d"))) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, user_id long, day int, item_id string").repartition(3)
    out = features.recent_items(df, "user_id", "day", "item_id", "row_id", 5)
    want = {i: [x[3] for x in sorted((x for x in rows if x[1] == u and x[2] < d), key=lambda x: (x[2], x[0]))][-5:] for i, u, d, _ in rows}
    assert {x.row_id: x.recent for x in out.collect()} == want
    assert "unboundedpreceding$(), -1" not in out._jdf.queryExecution().toString().lower()

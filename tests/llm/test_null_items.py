"""Benchmark items without an identifier contaminate like the others."""

import pytest

from impressa.llm import decontaminate
from tests.llm import brute


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST, 0])
def test_null_items_hit(spark, limit):
    docs = {1: "x one two three y", 2: "nothing here", 3: "four five one two three"}
    items = [(None, "one two three"), (None, "nothing"), (7, "four five")]
    df, bench = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, set(x["items"])) for x in decontaminate.scan(df, bench, max_broadcast=limit).collect()}
    assert got == brute.contamination(docs, items)
    assert decontaminate.drop_contaminated(df, bench, max_broadcast=limit).count() == 0

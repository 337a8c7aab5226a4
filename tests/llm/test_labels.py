"""The pipeline's stage fits on the usable labels only, as op10 does."""

from pyspark.sql import functions as F

from impressa.llm import quality


def test_unusable_labels_take_no_place(spark):
    docs = spark.createDataFrame([(i, "good clear words in a row " * 9 if i % 2 else "x9 !! ## ") for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)] + [(i, None) for i in range(60, 400)] + [(i, 1) for i in range(400, 2000)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    want = {x.doc_id for x in quality.score(docs, labels, max_labelled=30).where(F.col("score") >= quality.CUT).collect()}
    got = {x.doc_id for x in quality.keep_good(docs, labels, max_labelled=30).collect()}
    assert got == want and 0 < len(want) < 60

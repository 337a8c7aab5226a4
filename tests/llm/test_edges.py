"""Cases of nulls, repeats, lengths and clashing names."""

import os
import subprocess
import sys

import pytest

from impressa.llm import decontaminate, embeddings, jaccard, quality, substrings, urls, warc


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 0.01]), (None, [1.0, 0.0]), (6, None), (7, [0.0, 0.0]), (8, [1.0, None]), (3, [1.0, 0.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicates(df).collect()), key=str)
        assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True), (5, 2, 3, False), (None, 0, None, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True)], key=str)


def test_clashing_columns_pass_through(spark):
    names = ["_id", "_gone", "_bad", "_t", "_key", "_spans", "_starts", "_ends", "id", "rid", "y", "h", "x", "part"]
    text = "some plain words that go on for long enough to be removed as a repeat of more than fifty bytes " * 2
    docs = spark.createDataFrame([(i, text if i % 2 else f"other {i} words", *[7] * len(names)) for i in range(8)], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(8)], "doc_id long, quality int, y int")
    bench = spark.createDataFrame([(1, "other 2 words", 1)], "item_id long, text string, words int")
    assert jaccard.keep_first(docs).columns == docs.columns and jaccard.keep_first(docs).count() == 5
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert substrings.remove(docs).columns == docs.columns and substrings.remove(docs).count() == 8
    for limit in (10, 0):
        assert {x.doc_id for x in decontaminate.drop_contaminated(docs, bench, max_broadcast=limit).collect()} == {0, 1, 3, 4, 5, 6, 7}
        cleaned = {x.doc_id: x.text for x in decontaminate.remove_spans(docs, bench, max_broadcast=limit).select("doc_id", "text").collect()}
        assert cleaned[2] == "" and cleaned[4] == "other 4 words" and cleaned[1] == text


def test_spans_of_documents_without_an_identifier(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "x a b c y"), (3, None), (3, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "A b C")], "item_id long, text string")
    for limit in (10, 0):
        assert sorted(str(x.text) for x in decontaminate.remove_spans(docs, bench, max_broadcast=limit).collect()) == ["", "", "None", "x  y"]
        assert sorted((x.n_words, x.n_hit) for x in decontaminate.scan(docs, bench, max_broadcast=limit).collect()) == [(0, 0), (0, 0), (3, 3), (5, 3)]


def test_null_and_repeated_documents(spark):
    text = "w1 w2 w3 w4 w5 w6 w7 w8 w9 and some more words to make it a passage of fifty bytes"
    docs = spark.createDataFrame([(None, text), (2, text), (2, text), (1, text), (None, None)], "doc_id long, text string")
    assert sorted(((x.doc_id, x.component_id) for x in jaccard.classes(docs).collect()), key=str) == [(1, 1), (2, 1), (2, 1), (None, 1), (None, None)]
    assert sorted(((x.doc_id, x.n_removed > 0) for x in substrings.digests(docs).collect()), key=str) == [(1, False), (2, True), (2, True), (None, False), (None, False)]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_of_each_version(spark, version):
    fields = {1: "http://a/x 1.2.3.4 {date} text/html {n}", 2: "http://a/x 1.2.3.4 {date} text/html 200 - - 0 a.arc {n}"}[version]
    body = b"HTTP/1.0 200 OK\r\nX-Page-Id: none\r\n\r\n\xff\xfe caf\xe9"
    head = b"%d 0 x\n" % version
    lines = [f"filedesc://a 0.0.0.0 20240101000000 text/plain {'200 - - 0 a.arc ' if version == 2 else ''}{len(head)}\n".encode() + head, (fields.format(date="20240203040506", n=len(body)) + "\n").encode() + body + b"\n", b"not a header\n", (fields.format(date="never", n=len(body)) + "\n").encode() + body + b"\n"]
    got = warc.arc_to_records(spark.createDataFrame([("a.arc", b"".join(lines))], "name string, content binary")).collect()
    whole = [x for x in got if x.error is None]
    assert [x.date for x in whole] == ["2024-02-03T04:05:06Z", "1970-01-01T00:00:00Z"] and [x.page_id for x in whole] == [None, None]
    assert all(bytes(x.payload) == b"\xff\xfe caf\xe9" for x in whole) and [x.error for x in got if x.error] == ["bad header line"]


def test_both_versions_are_written(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "p" * 900) for i in range(60)], "page_id long, url string, html string").repartition(2)
    heads = {bytes(x.content).split(b"\n")[1].split(b" ")[0] for x in warc.arc_archives(pages, archive_bytes=4000).collect()}
    assert heads == {b"1", b"2"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_url_labels_with_nulls_and_ties(spark):
    labels = spark.createDataFrame([("http://a.org/x", "block"), ("http://a.org/x", "allow"), ("http://b.org/y", None), (None, "block")] * 3, "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/x"), (None, None), (1, "http://a.org/x")], "page_id long, url string")
    got = [(x.page_id, x.verdict) for x in urls.judge(pages, labelled=labels).collect()]
    assert len(got) == 3 and len({v for i, v in got if i == 1}) == 1


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "long " * 50000)], "doc_id long, text string")
    for labels in ([], [(1, 1), (2, 1), (2, None)], [(1, 0), (2, 1), (3, 1), (3, 1), (None, 0)]):
        got = quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == 5 and all(0 <= x.score <= 1 for x in got)


TASKS = """
import importlib.util, sys, tempfile
spec = importlib.util.spec_from_file_location("entry_point", {repo!r} + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
for name in ("op1_ngram_jaccard_join", "op5_suffix_array_dedup", "op9_benchmark_decontamination", "op10_quality_classifier", "op8_lm_scoring"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_tasks_need_no_copy_of_the_library(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", TASKS.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.count(" 200\n") == 5, out.stderr[-2000:]

"""Further cases of nulls, repeated rows, lengths and clashing names, by operator and through the pipeline."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from impressa.llm import chat, kneser_ney, packing, quality


def test_chat_with_nulls_repeats_and_long_turns(spark):
    long = "word " * 400
    rows = [(None, 1, "user", "hi"), (None, 2, "assistant", "yo"), (1, None, None, "first"), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, 0, "user", long), (2, 1, "assistant", long), (3, 0, "assistant", None)]
    clash = ["n", "total", "window_id", "loss", "through"]
    turns = spark.createDataFrame([(*r, *["x"] * len(clash)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in clash))
    shown = chat.windows(turns, budget=100, history=30)
    assert {x.conv_id for x in shown.where("over_budget").collect()} == {2}
    got = {x.conv_id: x for x in chat.read_back(shown).collect()}
    want = {None: [("user", "hi"), ("assistant", "yo")], 1: [("", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], 2: [("user", long), ("assistant", long)], 3: [("assistant", "")]}
    assert set(got) == set(want)
    for c, own in want.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_packing_of_repeated_and_empty_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x y"), (4, "w " * 25)], "doc_id long, text string").selectExpr("*", "7 as bucket_len", "8 as piece", "9 as n_tokens")
    rows = packing.pack(docs, max_len=10, n_buckets=2, budget=20).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("1", 3), ("1", 3), ("2", 0), ("3", 0), ("4", 5), ("4", 10), ("4", 10), ("None", 2)]
    assert len({(r.bucket_len, r.batch_id, r.slot) for r in rows}) == len(rows)
    per = {}
    for r in rows:
        per.setdefault((r.bucket_len, r.batch_id), []).append(r.n_tokens)
    for (length, _), own in per.items():
        assert len(own) * length <= 20 or len(own) == 1


def test_scores_of_rows_without_an_identifier(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 as word", "2 as score")
    rows = kneser_ney.score(docs, order=3, prune=0).collect()
    assert len(rows) == 5 and all(np.isfinite(r.score) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1 and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert len({r.score for r in rows if r.doc_id in (None, 1)}) == 1


@pytest.mark.parametrize("labels", [[], [(1, 1, "x"), (2, None, "x"), (None, 0, "x")]])
def test_pipeline_of_nulls_repeats_and_clashing_names(spark, tmp_path, labels):
    clash = ["_id", "_gone", "_bad", "component_id", "score", "starts", "words", "n"]
    passage = "this passage of plain words goes on for more than fifty bytes and is met twice"
    texts = {1: f"alpha {passage} omega", 2: f"one two three four five six {passage} seven eight nine ten eleven twelve", 3: "same words in both of these rows here", 4: "Same words in both of these rows here", 5: None, 6: "", 7: "held benchmark words of the test", 8: "z " * 60_000}
    rows = [*texts.items(), (3, texts[3]), (None, "no identifier on this row at all")]
    docs = spark.createDataFrame([(i, t, "web", "en", len(t or ""), *[1] * len(clash)) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{c} int" for c in clash))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, note string").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "Held benchmark words of the test"), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert quality.keep_good(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).count() == len(rows)
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    # 4 is a copy of 3 and 7 benchmark text; 2 loses the passage and the spaces that 1 has around it too; both rows of 3 stay
    left = {**texts, 2: texts[2].replace(f" {passage} ", ""), None: rows[-1][1]}
    assert got == {i: len((left[i] or "").split()) * (2 if i == 3 else 1) for i in (1, 2, 3, 5, 6, 8, None)}

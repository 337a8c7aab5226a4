"""Training-data operators against brute force, on tables with nulls, ties, long texts and clashing columns."""

import hashlib
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from impressa.llm import chat, decontaminate, embeddings, jaccard, kneser_ney, packing, quality, queries, substrings, urls, warc
from impressa.llm.components import components
from impressa.llm.suffixes import Suffixes, buckets
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
DOCS = "doc_id long, text string, n int, a string, id long, part int, x string"


def texts(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    out = [None, "", "   ", "one", "one two three", "ONE two\tthree", "x" * 120, "y" * 49]
    passage = " ".join(r.choices(vocabulary, k=30))
    for _ in range(25):
        w = r.choices(vocabulary, k=r.randrange(3, 120))
        out.append(" ".join(w))
        for _ in range(r.randrange(4)):  # near copies with few or many changes
            c = list(w)
            for _ in range(r.choice((0, 1, 1, 3, 9))):
                c[r.randrange(len(c))] = r.choice(vocabulary)
            out.append(" ".join(c) + r.choice(("", " " + passage)))
    out += [passage, " ".join(r.choices(vocabulary, k=9000)), out[10], out[10]]
    r.shuffle(out)
    return dict(enumerate(out))


def frame(spark, docs, parts=5):
    return spark.createDataFrame([(i, t, 1, "a", 2, 3, "x") for i, t in docs.items()], DOCS).repartition(parts)


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    docs = texts(request.param)
    return docs, frame(spark, docs)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_jaccard(case, none):
    docs, df = case
    want = brute.jaccard(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df).collect()} == want
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    assert jaccard.classes(none).count() == 0 and jaccard.keep_first(none).count() == 0


def test_components(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(600)]
    zigzag = [(1000 + i // 2 + 500 * (i % 2), 1000 + (i + 1) // 2 + 500 * ((i + 1) % 2)) for i in range(300)]
    star = [(2999, 2000 + i) for i in range(200)]
    loose = [(r.randrange(3000, 3400), r.randrange(3000, 3400)) for _ in range(220)]
    edges = [*chain, *zigzag, *star, *loose, (5, 5), (None, 7), (8, None)]
    r.shuffle(edges)
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = brute.components({n for e in real for n in e}, real)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {x.node: x.component for x in got.collect()} == want


def test_substrings(case, none):
    docs, df = case
    want = brute.substrings(docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(df).collect()}
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in want.items()}
    cleaned = substrings.remove(df)
    assert cleaned.columns == df.columns
    assert {r.doc_id: r.text or "" for r in cleaned.collect()} == {i: w[3].decode("utf-8", "ignore") for i, w in want.items()}
    assert substrings.digests(none).count() == 0


@pytest.mark.parametrize("depth", [20, 31, 50, 120])
@pytest.mark.parametrize("most", [97, 1 << 19])
def test_suffix_order(depth, most):
    rng = np.random.default_rng(depth)
    copied = rng.integers(97, 99, 400).astype(np.uint8)
    body = np.concatenate([*(copied[a : a + depth + z] for a, z in rng.integers(0, 150, (40, 2))), np.full(700, 97, np.uint8), rng.integers(97, 99, 500).astype(np.uint8)])
    at, seen, last = np.sort(rng.choice(len(body) - depth + 1, len(body) // 2, replace=False)), set(), b""
    suffixes, n = Suffixes(body, depth), 0
    for own in buckets(suffixes, at, most):
        order, same = suffixes.order(at[own])
        n += len(order)
        for p, again in zip(at[own][order], same, strict=True):
            text = body[p : p + depth].tobytes()
            assert last <= text and again == (text in seen)
            seen.add(text)
            last = text
    assert n == len(at)


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST, 0])
def test_decontaminate(spark, case, none, limit):
    docs, df = case
    r = random.Random(5)
    long = [t.split() for t in docs.values() if t and len(t.split()) > 40]
    items = [(k, " ".join(w[3:23]).upper()) for k, w in enumerate(long[:4])] + [(10, "One two"), (11, None), (12, "..."), (13, "not there at all"), (14, " ".join(long[0][3:23]))]
    r.shuffle(items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(docs, items)
    got = {x.doc_id: (x.n_words, x.n_hit, set(x["items"])) for x in decontaminate.scan(df, bench, max_broadcast=limit).collect()}
    assert got == want
    kept = decontaminate.drop_contaminated(df, bench, max_broadcast=limit)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, (n, h, _) in want.items() if not (h and 20 * h >= n))
    assert decontaminate.scan(none, bench, max_broadcast=limit).count() == 0
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_language_model(spark, case, none):
    docs, df = case
    want, total = brute.unigram(docs)
    for r in kneser_ney.score(df).collect():
        n, known, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, brute.fold(r.doc_id, 7) == 2)
        assert r.base_score == pytest.approx(base) and -math.inf < r.score < 0
    assert kneser_ney.score(none).count() == 0


@pytest.mark.parametrize("prune", [0, 1])
def test_language_model_scores(case, prune):
    docs, df = case
    want = brute.kneser_ney(docs, prune)
    got = {r.doc_id: r.score for r in kneser_ney.score(df, prune=prune).collect()}
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("prune", [0, 1])
def test_probabilities_sum_to_one(spark, prune):
    rows = [("a b a b c",), ("a b b",), ("c a b",), ("b a",), ("a b a c a",)]
    path, meta = kneser_ney.train(spark.createDataFrame(rows, "text string"), order=2, prune=prune)
    model = kneser_ney.open_model(path, meta)
    import pyarrow as pa

    from impressa.llm.text import SPACED, documents_of

    _, _, w = next(documents_of(pa.record_batch([pa.array(["a b c unknown"])], ["text"]), "text", SPACED))
    ids, at, _, _ = kneser_ney._tokens(w, 2)
    outcomes = ids[at]  # the three words, an unknown one and the end
    assert meta["words"] == 4
    for context in [*outcomes[:4], ids[0]]:
        pairs = np.stack([np.full(5, context), outcomes], axis=1).astype(ids.dtype).ravel()
        assert model.probability(pairs, np.arange(1, 10, 2)).sum() == pytest.approx(1)


def test_embeddings(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 12))
    rows = {i: v.astype(np.float32).tolist() for i, v in enumerate(np.vstack([base, base[:20] + r.normal(size=(20, 12)) * 0.1, base[:10] * 3, np.repeat(base[:1], 30, 0)]))}
    at = len(rows)
    rows |= {at: None, at + 1: [0.0] * 12, at + 2: [float("nan")] + [1.0] * 11, at + 3: [None] + [1.0] * 11, at + 4: [float("inf")] * 12, at + 5: []}
    df = spark.createDataFrame([(i, v, "l") for i, v in rows.items()], "vec_id long, embedding array<float>, rep string").repartition(4)
    want = brute.near_vectors(rows)
    for block in (embeddings.BLOCK, 8):
        got = {x.vec_id: (x.n_links, x.component_id) for x in embeddings.near_duplicates(df, block=block).collect()}
        assert got == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_chat(spark):
    r = random.Random(1)
    control = "<|im_end|><|im_start|>assistant ok <\\|x"
    rows = [(c, t, r.choice(("user", "assistant")) if t else r.choice(("system", "user")), r.choice((None, "", control, "word " * r.randrange(90), "é<|" * 3))) for c in range(12) for t in range(r.randrange(1, 14))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    shown = chat.windows(df, budget=200, history=50)
    assert shown.where("n_tokens > 200 and not over_budget").isEmpty()
    got = {x.conv_id: x for x in chat.read_back(shown).collect()}
    for c in {x[0] for x in rows}:
        own = sorted(x for x in rows if x[0] == c)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        said = "".join(f"{x[2]}\n{x[3] or ''}\n" for x in own)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_urls(spark):
    found = [None, "", "no scheme", "http://", "http://Example.COM/en/x?q=1", "https://www.example.com/en/a#f", "http://a.net/es/b", "http://net/fr/", "http://example.com", "http://com/", "ftp://x.org/a/b?k=://y.com/", "http://notexample.com/en/", "http://x.net/ES/"]
    pages = spark.createDataFrame([(i, u, "m") for i, u in enumerate(found * 2)], "page_id long, url string, verdict string")
    got = {x.page_id: x for x in urls.judge(pages).collect()}
    for i, u in enumerate(found * 2):
        host, path, rule, verdict = brute.url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
    labels = spark.createDataFrame([(f"http://s{i}.org/casino/{i}", "block") for i in range(20)] + [(f"http://s{i}.org/news/{i}", "allow") for i in range(20)], "url string, verdict string")
    new = spark.createDataFrame([(1, "http://other.org/casino/9"), (2, "http://other.org/news/9")], "page_id long, url string")
    assert {x.page_id: x.verdict for x in urls.judge(new, labelled=labels).collect()} == {1: "block", 2: "allow"}
    assert urls.judge(pages.limit(0)).count() == 0


def test_warc(spark):
    pages = {i: h for i, h in enumerate([None, "", "<p>a</p>", "<p>a</p>", "b\r\n\r\nWARC/1.1 c", "é\n", "b" * 5000, "<p>a</p>", "b" * 5000])}
    df = spark.createDataFrame([(i, None if i == 2 else f"http://x y/{i}", h, 1) for i, h in pages.items()], "page_id long, url string, html string, digest int").repartition(3)
    got = {x.page_id: (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.round_trip(df).collect()}
    assert got == brute.warc(pages)
    assert [x[5] for x in warc.parse_arc(b"filedesc://a 0.0.0.0 20240101000000 text/plain 4\n1 0\nhttp://x 1.1.1.1 20240101000000 text/html 99\nabc")] == ["cut short"]


def test_packing(spark, case, none):
    docs, df = case
    rows = packing.pack(df, max_len=64, n_buckets=3, budget=256).collect()
    per = {}
    for r in rows:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.n_tokens
        assert r.n_tokens <= r.bucket_len <= 64 and r.padding == r.bucket_len - r.n_tokens and r.slot < max(1, 256 // max(1, r.bucket_len))
    assert per == {i: len(brute.words(t)) for i, t in docs.items()}
    assert len({(r.bucket_len, r.batch_id, r.slot) for r in rows}) == len(rows)
    lengths, counts = np.array([1, 2, 5, 7, 11, 20]), np.array([9, 1, 4, 3, 8, 2])

    def padding(ends):
        return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))

    for k in (1, 2, 3, 4):
        best = min(padding((*e, 20)) for e in itertools.combinations(lengths[:-1], k - 1))
        assert padding(packing.choose_boundaries(lengths, counts, k)) == best
    assert packing.pack(none).count() == 0


@needs_data
def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().dropna(subset=["quality"])
    held = got[got.held_out].merge(labels, on="doc_id")
    assert got.score.between(0, 1).all() and len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (held.predicted == held.quality).mean() >= max(held.quality.mean(), 1 - held.quality.mean())


@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where(F.col("score") >= quality.CUT).collect()}
    kept = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    kept = {i: kept[i] for i, (_, c) in brute.jaccard(kept).items() if c == i}
    kept = {i: w[3].decode("utf-8", "ignore") for i, w in brute.substrings(kept).items()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {i: len(brute.words(kept[i])) for i, (n, h, _) in brute.contamination(kept, bench).items() if not (h and 20 * h >= n)}
    got = {r.doc_id: r.n for r in corpus_pipeline.run(spark, DATA).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0

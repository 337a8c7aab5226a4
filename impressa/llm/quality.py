"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document of quality 1 is preferred to one of quality 0.  Scores are linear in
binned text statistics; the weights maximise the Bradley-Terry likelihood of
the pairs, i.e. a logistic loss on feature differences (Spark ML logistic
regression without intercept).  The cut is a quantile of the training scores,
the one with the fewest training errors, and scores are mapped by a sigmoid to
(0, 1) so that the cut falls on ``CUT``.

Statistics cover every whole text.  Only the fit reads a sample: at most
``max_labelled`` labelled documents, those with the smallest hash of their id.

Null and empty texts have zero statistics and are scored like any other; null
labels and labels without a document are ignored; a document labelled twice
counts twice; rows that repeat a doc_id must repeat its text (one of them is
fitted on, each is scored); a very long text is one row of statistics; if only
one class is labelled all documents are scored alike; further columns, whatever
their names, pass through keep_good and are not read; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impressa.llm.shared import cut, keyed, remainder, small_batches, trimmed
from impressa.llm.text import SPACED, documents_of, string_buffer

CUT = 0.3
MAX_LABELLED = 20_000
N_BINS = 12
FEATURES = ("log_words", "log_distinct_ratio", "distinct_share", "mean_length", "max_length", "upper", "digits", "marks", "repeats", "marked_words", "bars", "top_word", "sentence_words", "line_words", "short_words", "beyond_ascii", "repeated_pairs")


def _statistics(w, data) -> np.ndarray:
    """One row of FEATURES for each document of a chunk."""
    n, docs = w.count.astype(float), w.n_docs
    some, size = np.maximum(n, 1), np.maximum(np.diff(w.offsets), 1).astype(float)
    h, length = w.hash, (w.end - w.start).astype(float)

    def total(values):  # of a byte mask, by document
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[w.offsets[1:]] - sums[w.offsets[:-1]]

    def words(values):
        return np.bincount(w.doc, values, minlength=docs)

    marks = ((data > 0x20) & (data < 0x30)) | ((data > 0x39) & (data < 0x41)) | ((data > 0x5A) & (data < 0x61)) | ((data > 0x7A) & (data < 0x80))
    mark_sums = np.concatenate(([0], np.cumsum(marks)))
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((h, w.doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top, distinct = np.zeros(docs), np.bincount(w.doc[order][new], minlength=docs)
    np.maximum.at(top, w.doc[order][new], runs)
    longest = np.zeros(docs)
    np.maximum.at(longest, w.doc, length)
    first, pairs = w.windows(2, h)
    pair_doc = w.doc[first]
    order = np.lexsort((pairs, pair_doc))
    again = np.zeros(len(pairs))
    again[1:] = (pairs[order][1:] == pairs[order][:-1]) & (pair_doc[order][1:] == pair_doc[order][:-1])
    repeated = np.bincount(pair_doc[order], again, minlength=docs)
    ends = total((data == 0x2E) | (data == 0x21) | (data == 0x3F))
    return np.column_stack([
        np.log1p(n), np.log1p(distinct) / np.log1p(some + 1), distinct / some, words(length) / some, longest, total((data > 0x40) & (data < 0x5B)) / size,
        total((data > 0x2F) & (data < 0x3A)) / size, total(marks) / size, words(same) / some, words((mark_sums[w.end] - mark_sums[w.start] >= 2).astype(float)) / some,
        total(data == 0x7C) / some, top / some, n / (ends + 1), n / (total(data == 0x0A) + 1), words((length <= 3).astype(float)) / some, total(data >= 0x80) / size, repeated / some])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each whole text, without a shuffle."""

    @trimmed
    def run(batches):
        for batch in batches:
            rows = [np.zeros((0, len(FEATURES)))]
            rows += [_statistics(w, raw) for w, raw in _with_case(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(np.vstack(rows)), pa.list_(pa.float64()))], ["doc_id", "x"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


def _with_case(batch):
    data, offsets = string_buffer(batch.column("text"))
    for first, last, w in documents_of(batch, "text", SPACED):
        yield w, data[offsets[first] : offsets[last]]


@dataclass
class Ranker:
    """Bin edges, weights of each bin, and the sigmoid that puts the cut on CUT."""

    edges: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for j, (edges, weights) in enumerate(zip(self.edges, self.weights, strict=True)):
            total += weights[np.searchsorted(edges, x[:, j], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _chosen(ids: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_labelled: int, folds: int = 5) -> DataFrame:
    """(doc_id, y, h): the at most max_labelled usable labels outside fold 0, of documents that there are, with the smallest hash of their id."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(remainder("doc_id", folds) != 0)
    return cut(known.join(ids, "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "y").limit(max_labelled))


def fit(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED, folds: int = 5) -> Ranker:
    """Learn from the labelled rows outside fold 0 of crc32(doc_id) mod ``folds``.

    Each of the sampled documents meets four of the other class: the pairs are
    drawn by position in the hash order, at most 4 * max_labelled of them.
    """
    chosen = _chosen(feats.select("doc_id"), labels, id_col, label_col, max_labelled, folds)
    sample = cut(feats.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").dropDuplicates(["doc_id"]).join(F.broadcast(chosen), "doc_id"))
    rows = sample.select("x", "y").toArrow()
    y = rows["y"].to_numpy()
    x = np.array(rows["x"].to_pylist()).reshape(-1, len(FEATURES))
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Ranker(np.zeros((len(FEATURES), 1)), np.zeros((len(FEATURES), 2)), 0.0 if share >= CUT else 1.0, 10.0)
    edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, N_BINS + 1)[1:-1]) for j in range(len(FEATURES))])
    tails = np.stack([np.quantile(x[:, j], [0.002, 0.01, 0.03, 0.97, 0.99, 0.998]) for j in range(len(FEATURES))])
    edges = np.sort(np.hstack([edges, tails]), axis=1)
    width = edges.shape[1] + 1

    # one-hot bins in Spark, differences of preferred and other, logistic loss without intercept
    grid = F.array(*[F.array(*[F.lit(float(e)) for e in row]) for row in edges])
    bins = sample.withColumn("e", grid).withColumn("b", F.expr("transform(x, (v, j) -> size(filter(e[j], t -> t <= v)))"))
    bins = bins.withColumn("x", F.expr(f"flatten(transform(b, v -> transform(sequence(0, {width - 1}), k -> if(k = v, 1d, 0d))))")).select("doc_id", "h", "y", "x")
    place = F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id")) - 1  # of the bounded sample
    ranked, n = bins.withColumn("r", place), {int(k): int((y == k).sum()) for k in (0, 1)}
    few, many = (0, 1) if n[0] <= n[1] else (1, 0)
    a = ranked.where(F.col("y") == many).select(F.col("x").alias("xa"), "r", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    a = a.withColumn("r", F.pmod(F.col("r") * 4 + F.col("k") * 7 + F.floor(F.col("r") * 4 / n[few]), F.lit(n[few])).cast("int"))
    b = ranked.where(F.col("y") == few).select(F.col("x").alias("xb"), "r")
    sign = 1.0 if many == 1 else -1.0
    pairs = a.join(b, "r").select(F.expr(f"zip_with(xa, xb, (p, q) -> {sign}d * (p - q))").alias("d"), (F.pmod(F.xxhash64("r", "k"), F.lit(2))).cast("double").alias("label"))
    pairs = pairs.select("label", array_to_vector(F.expr("if(label = 1, d, transform(d, v -> -v))")).alias("features"))
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=3e-4, maxIter=60).fit(pairs)
    ranker = Ranker(edges, model.coefficients.toArray().reshape(len(FEATURES), width), 0.0, 1.0)

    raw = ranker.raw(x)
    ranker.cut = _quantile_cut(raw, y)
    spread = np.abs(raw - ranker.cut)
    ranker.slope = 3 / max(float(np.median(spread)), 1e-9)
    return ranker


def _quantile_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The middle of the score quantiles with the fewest training errors."""
    levels = np.quantile(raw, np.linspace(0, 1, 1001))
    order = np.argsort(raw, kind="stable")
    s, ones = raw[order], np.concatenate(([0], np.cumsum(y[order])))
    at = np.searchsorted(s, levels, "left")  # those below a level are rejected
    errors = ones[at] + (len(y) - at) - (ones[-1] - ones[at])
    best = levels[errors == errors.min()]
    low = best[len(best) // 2]
    below = s[s < low]
    return float((low + below[-1]) / 2) if len(below) else float(low)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id and score of every document.  The statistics are computed once and written to the shared folder."""
    feats = cut(features(docs, id_col, text_col))
    ranker = fit(feats, labels, id_col, label_col, max_labelled)

    @trimmed
    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ranker.score(x))], ["doc_id", "score"])

    return feats.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents scored CUT or more, with all their columns and without a shuffle of the texts.

    Statistics of the labelled documents are computed for the fit, and of all
    documents while filtering.
    """
    own = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = _chosen(own.select("doc_id"), labels, id_col, label_col, max_labelled).select("doc_id").distinct()
    ranker = fit(cut(features(own.join(F.broadcast(some), "doc_id", "left_semi"))), labels, id_col, label_col, max_labelled)

    @trimmed
    def run(batches):
        for batch in batches:
            text = batch.schema.get_field_index(text_col)
            named = batch.select([text]).rename_columns(["text"])
            rows = [np.zeros((0, len(FEATURES)))]
            rows += [_statistics(w, raw) for w, raw in _with_case(named)]
            yield batch.filter(pa.array(ranker.score(np.vstack(rows)) >= CUT))

    return small_batches(docs).mapInArrow(run, docs.schema)

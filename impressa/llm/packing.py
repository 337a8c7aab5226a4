"""Packing into optimal length buckets.

Tokens are those of a tokenizer file (:func:`token_lengths`), or words where none
is given.  Documents longer than ``max_len`` tokens become pieces of at most that
length.
The global histogram of piece lengths (at most max_len + 1 rows) goes to the
driver, where dynamic programming chooses the ``n_buckets`` boundaries with the
least padding.  Inside a bucket, pieces fill batches of ``budget`` padded
tokens.

Batches are numbered without gathering a bucket: pieces are dealt into shards
by the hash of their document, numbered within (bucket, shard), and shifted by
the count of the shards before.

Null and empty texts give one piece of 0 tokens in the first bucket; ties are
broken by doc_id and piece; repeated doc_ids are kept as separate pieces, which
share their numbers; a very long text is many pieces; further columns, whatever
their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.llm.shared import cut, keyed, trimmed
from impressa.llm.tokens import broadcast_file, count_tokens

MAX_LEN = 2048
N_BUCKETS = 8
BUDGET = 16_384
ROWS_PER_SHARD = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text_col: str) -> Column:
    """Words separated by ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def token_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and length, the tokens of the whole text by a byte-level BPE file; a null text has none."""
    raw = broadcast_file(docs.sparkSession, tokenizer)

    @trimmed
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count_tokens(batch.column("text"), raw.value))], ["doc_id", "length"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, length long")


def choose_boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int = N_BUCKETS) -> list[int]:
    """Bucket boundaries (largest lengths) with the least total padding; at most n_buckets.

    cost(i, j) pads all lengths after the i-th up to the j-th to the j-th; the
    best split into k buckets extends the best split into k - 1.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate(([0.0], np.cumsum(counts)))
    best, splits = lengths * c[1:], []  # one bucket for the first j + 1 lengths
    for _ in range(1, min(n_buckets, n)):
        new, at = best.copy(), np.full(n, -1)
        for j in range(1, n):
            total = best[:j] + lengths[j] * (c[j + 1] - c[1 : j + 1])
            i = int(np.argmin(total))
            if total[i] < new[j]:
                new[j], at[j] = total[i], i
        splits.append(at)
        best = new
    ends, j = [n - 1], n - 1
    for at in reversed(splits):
        if at[j] >= 0:
            j = int(at[j])
            ends.append(j)
    return sorted({int(lengths[e]) for e in ends})


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, length: Column | None = None) -> DataFrame:
    """doc_id, piece, first token and n_tokens; a document of up to max_len tokens is one piece."""
    n = token_count(text_col) if length is None else length.cast("long")
    out = docs.select(F.col(id_col).alias("doc_id"), n.alias("total"))
    last = F.greatest(F.ceil(F.col("total") / max_len) - 1, F.lit(0)).cast("long")
    out = out.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return out.select("doc_id", "piece", (F.col("piece") * max_len).alias("first_token"), F.least(F.lit(max_len).cast("long"), F.col("total") - F.col("piece") * max_len).alias("n_tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """Per piece: doc_id, piece, first_token, n_tokens, bucket_len, padding, batch_id, slot.

    batch_id is unique over all buckets together with bucket_len; a batch holds
    max(1, budget // bucket_len) slots.
    """
    rows = cut(pieces(docs, id_col, text_col, max_len, length))
    found = rows.groupBy("n_tokens").count().collect()  # at most max_len + 1 rows
    lengths, counts = np.array([r["n_tokens"] for r in found]), np.array([r["count"] for r in found])
    ends = choose_boundaries(lengths, counts, n_buckets) or [0]
    shards = max(8, int(counts.sum()) // ROWS_PER_SHARD if len(counts) else 0)
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= e, F.lit(e)) for e in ends])
    rows = rows.withColumn("bucket_len", bucket.cast("long")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    sizes = rows.groupBy("bucket_len", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("bucket_len", "shard", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("doc_id", "piece", "n_tokens")) - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    at = F.col("place") + F.col("before")
    return (rows.withColumn("place", place).join(offsets, ["bucket_len", "shard"])
            .select("doc_id", "piece", "first_token", "n_tokens", "bucket_len", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"), F.floor(at / capacity).cast("long").alias("batch_id"), (at % capacity).cast("long").alias("slot")))

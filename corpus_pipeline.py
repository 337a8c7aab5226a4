"""Training-data pipeline: quality, near duplicates, repeated passages, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept.  All but the last return the columns of documents, whatever further
columns there are.

Null and empty texts are documents: they are scored, link with nothing, lose
nothing, hold no benchmark words and are packed as one piece of no tokens.  A
null doc_id passes every stage but is never the kept one of a group.  Rows that
repeat a doc_id must repeat its text; they stay or go together.  Very long
texts are handled whole.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.llm import decontaminate, jaccard, packing, quality, substrings
from impressa.llm.shared import remove_dir, shared_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return jaccard.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document has in a 50-byte string."""
    return substrings.remove(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without more than a twentieth of benchmark words."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in batches of optimal length buckets."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]

#: The ranking, the pieces' byte cuts and the bucket choice are not SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder, read by the next and then removed; the last one stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove_dir(spark, f"{base}/{k - 1}")
    return docs

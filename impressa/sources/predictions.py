"""Prediction files and submissions: read, check, write."""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.sources import ordered
from impressa.sources.shared import shared_folder

SCORE_NAMES = ("score", "scores", "prediction", "predictions")
HEADER = ("row_id", "user_id", "video_id", "score")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, score) of a CSV with one of SCORE_NAMES, or of an npy or npz array in row order.

    An npy is read by byte ranges; an npz holds compressed members, of which
    the one that is named like a score is written to the shared folder first.
    """
    if path.endswith(".npz"):
        path = _member(spark, path)
    if path.endswith(".npy"):
        spark.dataSource.register(ordered.NpySource)
        return spark.read.format("npy").option("path", path).load()
    rows = spark.read.option("header", True).csv(path)
    name = next((n for n in SCORE_NAMES if n in rows.columns), None)
    if name is None:
        raise ValueError(f"no column named {', '.join(SCORE_NAMES)}")
    if "row_id" not in rows.columns:
        raise ValueError("a score file needs row_id: lines have no order in Spark")
    return rows.select(F.col("row_id").cast("long").alias("row_id"), F.expr(f"try_cast(`{name}` as double)").alias("score"))


def _member(spark: SparkSession, path: str) -> str:
    """The score member of an npz as a file of the shared folder, copied in pieces."""
    with zipfile.ZipFile(path) as z:
        name = next((n for n in SCORE_NAMES if f"{n}.npy" in z.namelist()), None)
        if name is None:
            raise ValueError(f"no array named {', '.join(SCORE_NAMES)}")
        where = urlparse(shared_folder(spark))
        if where.scheme not in ("", "file"):
            raise ValueError(f"an npz is unpacked to a mounted folder, not {where.scheme}://: give an npy")
        out = f"{unquote(where.path)}/{uuid.uuid4().hex}.npy"
        os.makedirs(os.path.dirname(out), exist_ok=True)
        with z.open(f"{name}.npy") as f, open(out, "wb") as g:
            shutil.copyfileobj(f, g, 1 << 20)
    return out


def alignment(predictions: DataFrame, target: DataFrame) -> DataFrame:
    """One row: counts, misaligned rows, the first of them, non-finite scores, and whether all is well."""
    p = predictions.select(F.col("row_id").alias("_r"), F.col("user_id").alias("_u"), F.col("item_id").alias("_i"), "score", F.lit(True).alias("_p"))
    t = target.select("row_id", "user_id", "item_id", F.lit(True).alias("_t"))
    j = t.join(p, F.col("row_id") == F.col("_r"), "full")
    same = F.col("_p").isNotNull() & F.col("_t").isNotNull() & F.col("user_id").eqNullSafe(F.col("_u")) & F.col("item_id").eqNullSafe(F.col("_i"))
    bad_score = F.col("_p").isNotNull() & (F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")))
    out = j.agg(F.count("_t").alias("target_rows"), F.count("_p").alias("pred_rows"), F.count_if(~same).alias("misaligned"), F.min(F.when(~same, F.coalesce("row_id", "_r"))).alias("first_bad"), F.count_if(bad_score).alias("nonfinite"), F.count_distinct("score").alias("distinct_scores"))
    return out.withColumn("ok", (F.col("misaligned") == 0) & (F.col("nonfinite") == 0))


def health(predictions: DataFrame, target_rows: int | None = None) -> DataFrame:
    """One row: rows, non-finite scores, and minimum, maximum and exact distinct count of the finite ones."""
    s = F.col("score")
    ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    out = predictions.agg(F.count(F.lit(1)).alias("pred_rows"), F.count_if(~ok).alias("nonfinite"), F.min(F.when(ok, s)).alias("min_score"), F.max(F.when(ok, s)).alias("max_score"), F.count_distinct(F.when(ok, s)).alias("distinct_scores"))
    return out if target_rows is None else out.withColumn("rows_match", F.col("pred_rows") == target_rows)


def write_submission(scores: DataFrame, path: str) -> None:
    """row_id, user_id, video_id, score with six significant digits, sorted by row_id across files."""
    rows = scores.select("row_id", "user_id", "video_id", F.format_string("%.6g", "score").alias("score"))
    rows.orderBy("row_id").write.mode("overwrite").option("header", True).csv(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """A checked submission: exact header, numeric finite scores."""
    rows = spark.read.option("header", True).csv(path)
    if tuple(rows.columns) != HEADER:
        raise ValueError(f"header must be {','.join(HEADER)}")
    return rows.select(F.col("row_id").cast("long").alias("row_id"), "user_id", "video_id", F.expr("try_cast(score as double)").alias("score"))


def template(target: DataFrame) -> DataFrame:
    """Zero scores for every row."""
    return target.select("row_id", F.lit(0.0).alias("score"))

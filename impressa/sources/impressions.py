"""Impression scans: CSV logs with an item dimension, and the adapter of the driver's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.sources import ordered

LOG_COLUMNS = ("date", "user_id", "video_id", "tab", "duration_ms")
DIMENSION_COLUMNS = ("video_id", "author_id")
#: Inclusive date ranges by split.
CSV_SPLITS = {"train": (20220408, 20220421), "valid": (20220422, 20220428), "test": (20220429, 20220508)}
EVENT_SPLITS = {"train": (20240101, 20240114), "valid": (20240115, 20240121), "test": (20240122, 20240130)}


def split_of(date: Column, splits: dict) -> Column:
    """Split name of an int date; null outside every range."""
    return F.coalesce(*[F.when(date.between(a, b), F.lit(name)) for name, (a, b) in splits.items()])


def require_columns(df: DataFrame, needed, what: str) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")


def _csv(spark: SparkSession, path: str, what: str, needed) -> DataFrame:
    """row_id in file order, and the columns as text."""
    rows = ordered.read_csv(spark, path)
    require_columns(rows, needed, what)
    return rows


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """video_id to author_id; of duplicates the last row of the file wins."""
    rows = _csv(spark, path, "dimension", DIMENSION_COLUMNS)
    return rows.groupBy("video_id").agg(F.max_by(F.coalesce("author_id", F.lit("")), "row_id").alias("author_id"))


def read_logs(spark: SparkSession, paths: list[str], dimension: str, include_test: bool = False, expose_test_labels: bool = False, splits=None) -> DataFrame:
    """Impressions of the CSV logs; row_id counts the rows of all files in their order, from 0.

    Any label but the string 0 is 1, an absent item's author is UNK and a
    present item's empty author stays empty, dates outside the splits are
    dropped, and test labels are null unless exposed.
    """
    logs, before = None, F.lit(0).cast("long")
    for path in paths:
        part = _csv(spark, path, "log", LOG_COLUMNS)
        if "long_view" not in part.columns:
            part = part.withColumn("long_view", F.lit(None).cast("string"))
        part = part.select((F.col("row_id") + before).alias("row_id"), *LOG_COLUMNS, "long_view")
        logs = part if logs is None else logs.unionByName(part)
        if len(paths) > 1:
            before = F.lit(logs.agg(F.coalesce(F.max("row_id") + 1, F.lit(0))).first()[0])
    authors = read_dimension(spark, dimension).select(F.col("video_id").alias("_v"), "author_id", F.lit(True).alias("hit"))
    date = F.col("date").cast("int")
    rows = logs.withColumn("split", split_of(date, splits or CSV_SPLITS)).where("split is not null")
    if not include_test:
        rows = rows.where("split <> 'test'")
    label = F.when(F.col("long_view") == "0", 0).otherwise(1)
    if not expose_test_labels:
        label = F.when(F.col("split") != "test", label)
    rows = rows.join(authors, F.col("video_id") == F.col("_v"), "left")
    author = F.when(F.col("hit").isNull(), "UNK").otherwise(F.coalesce("author_id", F.lit("")))
    return rows.select("row_id", "split", date.alias("date"), "user_id", "video_id", author.alias("author_id"), "tab", F.col("duration_ms").cast("double").alias("duration_ms"), label.cast("int").alias("label"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as impressions: a purchase is a positive label, props.k the item."""
    item = F.get_json_object("props", "$.k")
    date = F.date_format("ts", "yyyyMMdd").cast("int")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("row_id"), "user_id", item.alias("item_id"), (item.cast("int") % 10).alias("author_id"), F.col("event_type").alias("tab"), F.col("value").alias("duration"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"), date.alias("date"))
    return rows.withColumn("split", split_of(F.col("date"), EVENT_SPLITS)).where("split is not null")


def hide_labels(df: DataFrame, split: str = "test") -> DataFrame:
    """The label column is null in the hidden split."""
    return df.withColumn("label", F.when(F.col("split") != split, F.col("label")))


def preview(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """The first rows of a raw table."""
    return spark.read.option("header", True).csv(path).limit(rows)

"""JSON and JSONL sources and sinks of an experiment session."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

EVENT_SCHEMA = (
    "ts string, type string, round int, role string, model string, text string, kind string, name string, detail string, tokens_in long, tokens_out long, "
    "retries int, verdict string, seconds double, fidelity string, ctr_auc double, cvr_auc double, error string")
INTERVENTION_SCHEMA = "time string, round int, what string"
ROUND_SCHEMA = (
    "round_id int, run_id string, started_at string, backups array<string>, steps array<struct<role:string,seconds:double,tokens:bigint>>, fidelity string, "
    "run_ok boolean, metrics string, recoveries array<string>, interventions int, tokens long, seconds double, train_seconds double")


def read_jsonl(spark: SparkSession, paths, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; a path given twice is read once and blank lines are skipped."""
    unique = list(dict.fromkeys([paths] if isinstance(paths, str) else paths))
    return spark.read.schema(schema).json(unique)


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def append_jsonl(df: DataFrame, folder: str) -> None:
    """One file per batch: Spark does not append inside a file."""
    df.write.mode("append").json(folder)


def write_snapshot(df: DataFrame, folder: str, round_id: int) -> None:
    """A ledger's state of one round, replacing only that round's."""
    df.write.mode("overwrite").json(f"{folder}/round={round_id}")


def read_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A YAML list of records (symptoms, cards, task files)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f)
    fields = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r.get(c) for c in fields) for r in rows], schema)


def plain_json(value) -> str:
    """JSON of a report with numpy scalars and arrays made plain."""
    return json.dumps(value, ensure_ascii=False, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x))

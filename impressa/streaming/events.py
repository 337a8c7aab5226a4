"""The live event log as a stream: one file per batch of events."""

from __future__ import annotations

import logging
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from impressa.sources.ledgers import EVENT_SCHEMA, append_jsonl

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the library

#: Characters of a chunk of text.
CHUNK = 4_096

#: The fields that an event may have.
EVENT_FIELDS = tuple(field.split(" ")[0] for field in EVENT_SCHEMA.split(", "))


def emit(events: DataFrame, folder: str | None, once: str | None = None) -> bool:
    """Append events, without fields that are not listed; was it written?  No folder writes nothing.

    ``once`` names the batch: one that is sent again takes the place of what
    was written before.

    A log is only watched: if it cannot be written, that is logged and the
    caller goes on.
    """
    if not folder:
        return False
    try:
        listed = events.select(*[c for c in events.columns if c in EVENT_FIELDS])
        if once is None:
            append_jsonl(listed, folder)
        else:
            listed.write.mode("overwrite").json(f"{folder}/batch={once}")
    except Exception:  # whatever is wrong with the log's storage
        logging.getLogger(__name__).warning("events were not written to %s", folder, exc_info=True)
        return False
    return True


def tail(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Events as they are added; the checkpoint of the query that reads them is the offset."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def drain(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Append what has come since the last call to ``sink`` (parquet), then return."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def assemble_text(events: DataFrame) -> DataFrame:
    """Per kind: the text pieces (kind, seq, text) joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return events.groupBy("kind").agg(F.array_join(parts, "").alias("text"))


def once_per_batch(folder: str):
    """A foreachBatch sink that writes each batch to a folder of its own: a replayed batch is written once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


class _Chunks(StatefulProcessor):
    """Per kind: the number of the open chunk, and its text so far."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", "chunk long, text string")

    def handleInputRows(self, key, rows, timers):
        import pandas as pd

        chunk, text = self.open.get() if self.open.exists() else (0, "")
        pieces = pd.concat(list(rows))[["seq", "text"]].sort_values("seq", kind="stable")
        for piece in pieces["text"].dropna():
            text += piece
            if len(text) >= self.size:
                whole = len(text) // self.size
                yield pd.DataFrame({"kind": [key[0]] * whole, "chunk": range(chunk, chunk + whole), "text": [text[k * self.size : (k + 1) * self.size] for k in range(whole)], "whole": [True] * whole})
                chunk, text = chunk + whole, text[whole * self.size :]
        self.open.update((chunk, text))
        if text:
            yield pd.DataFrame({"kind": [key[0]], "chunk": [chunk], "text": [text], "whole": [False]})

    def close(self) -> None:
        """The state store is closed by Spark."""


def chunks(stream: DataFrame, size: int = CHUNK) -> DataFrame:
    """(kind, chunk, text, whole) of a stream of pieces (kind, seq, text) that come in order of seq: texts of ``size`` characters, by number.

    The last chunk of a kind is given with each batch that adds to it; of
    several rows with one number the latest holds.  The state has less than a
    chunk per kind.  A batch of a kind is put together in one task: bound
    batches by the source.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.select("kind", "seq", "text").groupBy("kind").transformWithStateInPandas(_Chunks(size), "kind string, chunk long, text string, whole boolean", "update", "none")


def drain_chunks(stream: DataFrame, folder: str, checkpoint: str, size: int = CHUNK) -> None:
    """Chunks of what has come since the last call, a folder per batch, then return."""
    chunks(stream, size).writeStream.foreachBatch(once_per_batch(folder)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, chunk, text) as the last batch that has a chunk gives it."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("kind", "chunk").agg(F.max_by("text", "batch").alias("text"))


def chunks_between(pieces: DataFrame, start: int, end: int, size: int = CHUNK, block: int = 10_000) -> DataFrame:
    """(kind, chunk, text) of the pieces (kind, seq, text) with start <= seq < end, in order of seq.

    Places come from the lengths of blocks of ``block`` sequence numbers, so no
    task holds a whole kind; null texts are empty.
    """
    rows = pieces.where((F.col("seq") >= start) & (F.col("seq") < end)).select("kind", "seq", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("seq") / block).alias("_block"))
    before = Window.partitionBy("kind").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("kind", "_block").agg(F.sum(F.length("text")).alias("_n")).select(F.col("kind").alias("_k"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("kind", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.length("text")).over(own), F.lit(0))).join(sums, F.col("kind").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    rows = rows.where("text <> ''").withColumn("_at", F.col("_at") + F.col("_first"))
    cut = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.length("text") - 1) / size))))
    first = F.greatest(F.col("chunk") * size - F.col("_at"), F.lit(0)).cast("int")
    part = F.substring("text", first + 1, F.least((F.col("chunk") + 1) * size - F.col("_at"), F.length("text")).cast("int") - first)
    return cut.select("kind", "chunk", F.struct("_at", part.alias("t")).alias("x")).groupBy("kind", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("text"))

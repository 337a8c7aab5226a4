"""Checkpoints, task memory and identifier helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only on a local master that names none (a test), a temporary folder is set.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="impressa-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names of its own."""
    return small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name += "_"
    return name


def remainder(id_col: str | Column, n: int) -> Column:
    """crc32 of the identifier written as text, modulo n."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string")) % n


def spread_join(many: DataFrame, one: DataFrame, on: str, by: Column, how: str = "inner") -> DataFrame:
    """``many`` joined with the one row that ``one`` has per key, where a key may hold a third of the rows.

    A key with more rows than a quarter of a partition's share is cut in pieces
    by a hash of ``by``, each with its own copy of the key's row.  There are at
    most four such keys per partition, so their list can be broadcast.
    ``many`` is read three times: give it written.
    """
    most = max(100, many.count() // (4 * int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(many.groupBy(F.col(on).alias("_hot")).count().where(F.col("count") > most).select("_hot", F.ceil(F.col("count") / most).alias("_pieces")))
    dealt = many.join(hot, F.col(on) == F.col("_hot"), "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(by), F.col("_pieces")), F.lit(0).cast("long"))).drop("_hot", "_pieces")
    copies = one.join(hot, F.col(on) == F.col("_hot"), "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1).cast("long")) - 1))).drop("_hot", "_pieces")
    return dealt.join(copies, [on, "_piece"], how).drop("_piece")


BATCH_ROWS = 1_000


def trimmed(run):
    """A function for mapInArrow that gives freed memory back when its partition is done; workers live on."""

    @functools.wraps(run)
    def wrapped(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass

    return wrapped


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the session's Arrow batches by BATCH_ROWS rows: texts are long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df

"""CSV and npy files read in file order: rows get the number they have in the files, whatever the splits.

A CSV file is cut into blocks by Spark's text reader, which knows each line's
block.  A first pass counts, per block, the quotes and the records that begin
there, both for a block that begins outside quotes and for one that begins
inside; prefix sums over the blocks then tell each block how it begins and
which number its first record has.  A second pass puts lines together to
records and numbers them.  Only records that cross the border of two blocks are
shuffled.  A task holds a batch of lines; the table of blocks has a row per
split.

An npy file is read by byte ranges that its header gives, one per task.
"""

from __future__ import annotations

import csv
import io
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from impressa.sources.shared import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the library

#: Blocks whose table is broadcast; at 128 MB a block this is 250 TB.
MAX_BLOCKS = 2_000_000
_BOM = "\ufeff"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (its first byte) and text of each line of a file or folder; lines of a block come in order."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))


def _runs(batches):
    """(file and block, rows) of each run of a batch's rows of one block."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            key = batch.column(0)[at], batch.column(1)[at]
            same = pc.and_(pc.equal(batch.column(0)[at:], key[0]), pc.equal(batch.column(1)[at:], key[1])).to_numpy(zero_copy_only=False)
            n = int(np.argmin(same)) if not same.all() else len(same)
            yield (key[0].as_py(), key[1].as_py()), batch.slice(at, n)
            at += n


def _begins(texts: pa.Array, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(lines that begin within quotes, lines that begin a record, quotes) of lines that follow one another, the first within quotes or not."""
    quotes = pc.count_substring(texts, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    within = (inside + np.cumsum(quotes) - quotes) % 2 == 1
    blank = pc.is_in(texts, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
    return within, ~within & ~blank, int(quotes.sum())


def _count(batches):
    out = {}
    for key, rows in _runs(batches):
        quotes, outside, inside = out.get(key, (0, 0, 0))
        (_, plain, more), (_, quoted, _) = _begins(rows.column("text"), quotes % 2), _begins(rows.column("text"), (quotes + 1) % 2)
        out[key] = quotes + more, outside + int(plain.sum()), inside + int(quoted.sum())
    found = [(*key, *counts) for key, counts in out.items()]
    names = ["file", "block", "quotes", "outside", "inside"]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found, strict=True)) or [[]] * 5, [pa.string(), *[pa.int64()] * 4], strict=True)], names)


def _pieces(texts: list, numbers: np.ndarray, broken: np.ndarray, base: int, block: int):
    n = len(numbers)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, base)), pa.array(numbers), pa.array(np.full(n, block)), texts, pa.array(broken)], ["base", "number", "piece", "text", "broken"])


def _assemble(batches):
    """Records of each block; pieces of a record that goes on in another block are marked.

    Of a block only one batch is held, and the lines of the record that it leaves open.
    """
    now, quotes, number, base, opened, cut_off = None, 0, 0, 0, [], False

    def rest():
        """What the block leaves open goes on in the next one."""
        if opened:
            yield _pieces(pa.array(["\n".join(opened)]), np.array([number]), np.array([True]), base, now[1])

    for key, rows in _runs(batches):
        if key != now:
            yield from rest()
            quotes, number, base = (rows.column(c)[0].as_py() for c in ("start", "first", "base"))
            # opened: texts of the record that is open; cut_off: it began in another block
            now, number, opened, cut_off = key, number - 1, [], quotes == 1
        within, begins, more = _begins(rows.column("text"), quotes % 2)
        quotes += more
        keep = np.flatnonzero(within | begins)
        if not len(keep):
            continue
        texts, begins = rows.column("text").take(pa.array(keep)), begins[keep]
        at = np.flatnonzero(begins)
        first = int(at[0]) if len(at) else len(keep)
        opened += ["\n".join(texts[:first].to_pylist())] if first else []
        if opened and (len(at) or quotes % 2 == 0):
            yield _pieces(pa.array(["\n".join(opened)]), np.array([number]), np.array([cut_off]), base, key[1])
            opened, cut_off = [], False
        if len(at):
            numbers, ends = number + 1 + np.arange(len(at)), np.append(at, len(keep))
            if quotes % 2:
                opened, ends = ["\n".join(texts[int(at[-1]) :].to_pylist())], ends[:-1]
            if len(ends) > 1:
                held = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts), "\n")
                yield _pieces(held, numbers[: len(held)], np.zeros(len(held), bool), base, key[1])
            number += len(at)
    yield from rest()


def records(spark: SparkSession, path: str) -> DataFrame:
    """row_id and text of the records of a file, or of a folder's files by name; each file's first record, its header, has no row."""
    lines = _lines(spark, path)
    blocks = cut(lines.mapInArrow(_count, "file string, block long, quotes long, outside long, inside long"))
    if blocks.limit(MAX_BLOCKS + 1).count() > MAX_BLOCKS:
        raise ValueError("too many blocks: raise spark.sql.files.maxPartitionBytes")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    blocks = blocks.withColumn("rows", F.when(F.col("start") == 0, F.col("outside")).otherwise(F.col("inside")))
    files = blocks.groupBy("file").agg(F.greatest(F.sum("rows") - 1, F.lit(0)).alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    blocks = cut(blocks.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(files, "file").select("file", "block", "start", "first", "base"))
    placed = lines.join(F.broadcast(blocks), ["file", "block"]).select("file", "block", "text", "start", "first", "base")
    found = placed.mapInArrow(_assemble, "base long, number long, piece long, text string, broken boolean").where("number > 0").withColumn("row_id", F.col("base") + F.col("number") - 1)
    whole = found.where("not broken").select("row_id", "text")
    if blocks.where("start = 1").isEmpty():
        return whole
    pieces = found.where("broken").groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(pieces)


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a file, or of a folder's first file."""
    first = _lines(spark, path).where("block = 0").groupBy("file").agg(F.first("text").alias("text")).orderBy("file").first()
    return next(csv.reader(io.StringIO(first.text.removeprefix(_BOM).rstrip("\r"))), []) if first else []


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """row_id (from 0, in file order; a folder's files follow by name) and the columns as text.

    Fields may hold line breaks in quotes; blank lines are no rows; an unquoted
    empty field is null; missing fields are null and more than the header has
    are dropped.  A file without rows, or an empty one, adds none.
    """
    names = header(spark, path)
    schema = ", ".join(f"`{n}` string" for n in names)
    if not names:
        return spark.createDataFrame([], "row_id long")
    text = F.regexp_replace("text", "\r$", "")
    return records(spark, path).select("row_id", F.from_csv(text, schema, {"escape": '"', "maxCharsPerColumn": "-1"}).alias("x")).select("row_id", "x.*")


class _Range(InputPartition):
    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


class NpySource(DataSource):
    """``npy``: (row_id, score) of a one-dimensional array of numbers, read by byte ranges.

    Options: path (mounted, or any that Arrow opens), rows (per task).
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row_id long, score double"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options["path"], int(self.options.get("rows", 4_000_000)))


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def _open(self):
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system.open_input_file(where)

    def _head(self, f):
        """(kind, rows, first byte) as the header has them."""
        from numpy.lib import format as npy

        raw = io.BytesIO(f.read_at(min(f.size(), 1 << 16), 0))
        shape, _, kind = {(1, 0): npy.read_array_header_1_0, (2, 0): npy.read_array_header_2_0}[npy.read_magic(raw)](raw)
        if len(shape) != 1:
            raise ValueError("scores must be one-dimensional")
        if kind.kind not in "fiub":
            raise ValueError(f"scores must be numbers, not {kind}")
        return kind, shape[0], raw.tell()

    def partitions(self):
        with self._open() as f:
            n = self._head(f)[1]
        return [_Range(k, min(self.rows, n - k)) for k in range(0, n, self.rows)] or [_Range(0, 0)]

    def read(self, partition):
        with self._open() as f:
            kind, _, at = self._head(f)
            for k in range(partition.first, partition.first + partition.n, 65_536):
                n = min(65_536, partition.first + partition.n - k)
                raw = f.read_at(n * kind.itemsize, at + k * kind.itemsize)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n)), pa.array(np.frombuffer(raw, kind, n).astype(float))], ["row_id", "score"])

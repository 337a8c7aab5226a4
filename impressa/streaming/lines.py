"""A growing text file as rows of numbered lines: from a line number in batch, with explicit offsets as a stream.

``numbered_lines`` reads a file by byte ranges.  A stream's offset holds the
lines and the bytes read so far, so a restarted query goes on at the next line;
a last line without its line feed waits until it is complete.  Blank lines are
counted and give no row.  Options: path (mounted, or any that Arrow opens),
start (the first line, default 0), maxBytes (of a batch of the stream, default
64 MB, but for the first after a start; a longer line is read whole), rangeBytes (of a task, default 8 MB).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the library

_PIECE = 1 << 20


class _Range(InputPartition):
    def __init__(self, line: int, first: int, end: int):
        self.line, self.first, self.end = line, first, end


class _File:
    """Positions and lines of one file."""

    def __init__(self, options):
        self.path, self.start = options["path"], int(options.get("start", 0))
        self.most, self.range = int(options.get("maxBytes", 64 << 20)), int(options.get("rangeBytes", 8 << 20))

    def open(self):
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return None if system.get_file_info(where).type == fs.FileType.NotFound else system.open_input_file(where)

    def ends(self, at: int, stop: int | None = None):
        """Arrays of the bytes after each line feed from ``at`` on."""
        f = self.open()
        if f is None:
            return
        with f:
            size = f.size()
            if size < at:
                raise ValueError(f"{self.path} is shorter than what was read of it")
            stop = size if stop is None else min(stop, size)
            while at < stop:
                piece = f.read_at(min(_PIECE, stop - at), at)
                yield np.flatnonzero(np.frombuffer(piece, np.uint8) == 10) + at + 1
                at += len(piece)

    def seek(self, lines: int) -> tuple[int, int]:
        """(lines, bytes) of the first lines, or of as many as there are."""
        line = at = 0
        for ends in self.ends(0) if lines else ():
            if line + len(ends) >= lines:
                return lines, int(ends[lines - line - 1])
            line, at = line + len(ends), int(ends[-1]) if len(ends) else at
        return line, at

    def upto(self, line: int, at: int, most: int | None) -> tuple[int, int]:
        """(lines, bytes) after the whole lines of the next ``most`` bytes, or after one line if it is longer."""
        here, seen = at, line
        for ends in self.ends(at):
            within = ends if most is None else ends[ends <= at + most]
            if len(within) == 0 < len(ends) and here == at:
                within = ends[:1]
            if len(within):
                seen, here = seen + len(within), int(within[-1])
            if len(within) < len(ends):
                break
        return seen, here

    def ranges(self, line: int, at: int, stop: int) -> list[_Range]:
        """Whole lines in ranges of some ``rangeBytes``."""
        out, first, n = [], at, line
        for ends in self.ends(at, stop):
            for k in np.flatnonzero(np.diff((ends - at) // self.range, prepend=(first - at) // self.range)):
                if ends[k] > first:
                    out.append(_Range(n, first, int(ends[k])))
                    n, first = line + int(k) + 1, int(ends[k])
            line += len(ends)
        return out + [_Range(n, first, stop)] * (first < stop)

    def read(self, part: _Range):
        with self.open() as f:
            texts = f.read_at(part.end - part.first, part.first).split(b"\n")
        rows = [(part.line + k, t.decode("utf-8", "replace")) for k, t in enumerate(texts) if t.strip()]
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), (pa.int64(), pa.string()), strict=True)], ["line", "value"])


class LineSource(DataSource):
    """``numbered_lines``: (line, value) of a file of lines."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "line long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_File(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_File(self.options))


class _Reader(DataSourceReader):
    def __init__(self, file: _File):
        self.file = file

    def partitions(self):
        line, at = self.file.seek(self.file.start)
        return self.file.ranges(line, at, self.file.upto(line, at, None)[1]) or [_Range(line, at, at)]

    def read(self, partition):
        return self.file.read(partition) if partition.first < partition.end else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, file: _File):
        self.file, self.last = file, None

    def initialOffset(self) -> dict:
        line, at = self.file.seek(self.file.start)
        return {"line": line, "byte": at}

    def latestOffset(self) -> dict:
        """The end of the next batch; a reader that has just been started is not told what was read before, so its first batch takes all there is."""
        self.last = self.file.upto(*self.last, self.file.most) if self.last else self.file.upto(*self.initialOffset().values(), None)
        return {"line": self.last[0], "byte": self.last[1]}

    def partitions(self, start: dict, end: dict):
        return self.file.ranges(start["line"], start["byte"], end["byte"])

    def read(self, partition):
        return self.file.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept that could be freed."""


def stream(spark: SparkSession, path: str, start: int = 0, **options) -> DataFrame:
    """The lines of a growing file as they come."""
    spark.dataSource.register(LineSource)
    return spark.readStream.format("numbered_lines").options(path=path, start=start, **options).load()


def read_from(spark: SparkSession, path: str, start: int = 0) -> tuple[DataFrame, int]:
    """(lines from number ``start`` on, the number to go on from)"""
    spark.dataSource.register(LineSource)
    file = _File({"path": path})
    end = file.upto(*file.seek(start), None)[0]
    rows = spark.read.format("numbered_lines").options(path=path, start=start).load()
    return rows.where(F.col("line") < end), end

"""Rows of files in file order: CSV with quoted line breaks over many splits, arrays by byte ranges."""

import csv
import random

import numpy as np
import pyarrow as pa
import pytest

from impressa.sources import impressions, ordered, predictions


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for k, v in zip(keys, ("64", "1"), strict=True):
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def write(path, rows, end="\n", bom=False):
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_row_id_is_file_order(spark, tmp_path, small_splits, end):
    r = random.Random(end)
    texts = ["x", "é", "line\nbreak", 'a "quote"', "\n\n\n", "long " * 60, "many\nlines\n" * 20, "comma, and", '"', "tail\r\n"]
    files = {}
    for name in ("b.csv", "a.csv", "c.csv"):
        files[name] = [(str(k), r.choice(texts), str(r.random())) for k in range(r.randrange(1, 90))]
        write(tmp_path / name, [("k", "text", "n"), *files[name]], end, bom=name == "a.csv")
    (tmp_path / "d.csv").write_text("k,text,n\n")
    want = [(i, *x) for i, x in enumerate(files["a.csv"] + files["b.csv"] + files["c.csv"])]
    got = ordered.read_csv(spark, str(tmp_path))
    assert got.columns == ["row_id", "k", "text", "n"]
    assert sorted(map(tuple, got.collect())) == want
    one = ordered.read_csv(spark, str(tmp_path / "b.csv"))
    assert sorted(map(tuple, one.collect())) == [(i, *x) for i, x in enumerate(files["b.csv"])]


def test_blank_lines_missing_and_further_fields(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n\n1,2\n\r\n3\n4,5,6\n,"7\n\n8"\n\n')
    got = sorted(map(tuple, ordered.read_csv(spark, str(tmp_path / "x.csv")).collect()))
    assert got == [(0, "1", "2"), (1, "3", None), (2, "4", "5"), (3, None, "7\n\n8")]
    (tmp_path / "y.csv").write_text("")
    assert ordered.read_csv(spark, str(tmp_path / "y.csv")).count() == 0


def test_logs_over_files_and_duplicate_dimension_rows(spark, tmp_path, small_splits):
    head = ("date", "user_id", "video_id", "tab", "duration_ms", "long_view")
    rows = [[(20220408 + i % 20, f"u{i}\n", f"v{i % 4}", "1", "2.5", str(i % 3)) for i in range(n)] for n in (40, 25)]
    for k, own in enumerate(rows):
        write(tmp_path / f"log{k}.csv", [head, *own])
    write(tmp_path / "dim.csv", [("video_id", "author_id"), *[(f"v{i % 3}", f"a{i}") for i in range(50)]])
    got = impressions.read_logs(spark, [str(tmp_path / f"log{k}.csv") for k in (0, 1)], str(tmp_path / "dim.csv")).collect()
    want = {i: (x[0], x[1], {"v0": "a48", "v1": "a49", "v2": "a47"}.get(x[2], "UNK"), int(x[5] != "0")) for i, x in enumerate(rows[0] + rows[1]) if x[0] <= 20220428}
    assert {r.row_id: (r.date, r.user_id, r.author_id, r.label) for r in got} == want


@pytest.mark.parametrize("kind", ["<f8", "<f4", ">f8", "<i4"])
def test_array_by_ranges(spark, tmp_path, kind):
    data = np.arange(1000).astype(kind) / (1 if "i" in kind else 8)
    np.save(tmp_path / "x.npy", data.astype(kind))
    spark.dataSource.register(ordered.NpySource)
    df = spark.read.format("npy").option("path", str(tmp_path / "x.npy")).option("rows", 130).load()
    assert df.rdd.getNumPartitions() == 8
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [(i, float(v)) for i, v in enumerate(data.astype(kind))]


def test_arrays_of_other_forms(spark, tmp_path):
    np.savez_compressed(tmp_path / "x.npz", other=np.zeros((2, 2)), scores=np.array([0.5, float("nan"), 2.0]))
    assert [str(r.score) for r in predictions.read_scores(spark, str(tmp_path / "x.npz")).orderBy("row_id").collect()] == ["0.5", "nan", "2.0"]
    np.save(tmp_path / "e.npy", np.zeros(0))
    assert predictions.read_scores(spark, str(tmp_path / "e.npy")).count() == 0
    np.save(tmp_path / "m.npy", np.zeros((2, 2)))
    with pytest.raises(Exception, match="one-dimensional"):
        predictions.read_scores(spark, str(tmp_path / "m.npy")).count()


@pytest.mark.parametrize("size", ["1", "7"])
def test_records_over_batches(spark, tmp_path, small_splits, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        r = random.Random(size)
        rows = [(str(k), r.choice(["x", "\n\n", "line\nbreak\n" * 9, '"', "", "long " * 40, 'a "b"\n\n"c"'])) for k in range(80)]
        write(tmp_path / "a.csv", [("k", "text"), *rows])
        want = [(i, k, t or None) for i, (k, t) in enumerate(rows)]
        assert sorted(map(tuple, ordered.read_csv(spark, str(tmp_path / "a.csv")).collect())) == want
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
        assert sorted(map(tuple, ordered.read_csv(spark, str(tmp_path / "a.csv")).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_block_is_not_held_whole():
    taken = []

    def lines():
        for k in range(50):
            taken.append(k)
            columns = {"file": ["f"] * 4, "block": [0] * 4, "text": [f"{k},x", f'{k},"a', "", '"'], "start": [0] * 4, "first": [0] * 4, "base": [5] * 4}
            yield pa.RecordBatch.from_pydict(columns)

    out = ordered._assemble(lines())
    first = next(out)
    assert len(taken) <= 2 and first.column("text").to_pylist()[0] == "0,x"
    found = [first.to_pylist(), *[b.to_pylist() for b in out]]
    assert [(x["number"], x["text"], x["broken"]) for b in found for x in b] == [(2 * k + j, (f"{k},x", f'{k},"a\n\n"')[j], False) for k in range(50) for j in (0, 1)]

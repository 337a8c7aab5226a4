"""Numbered lines with offsets, chunks of text over batches, and a sink that writes a batch once."""

import json
import random

import pytest

from impressa.streaming import events, lines


def put(path, *texts):
    with open(path, "a", newline="", encoding="utf-8") as f:
        f.write("".join(texts))


def test_lines_from_a_number(spark, tmp_path, monkeypatch):
    log = tmp_path / "log.jsonl"
    rows, end = lines.read_from(spark, str(log), 3)
    assert rows.count() == 0 and end == 0
    texts = [f'{{"n": {i}, "t": "{"é" * (i % 50)}"}}' for i in range(300)]
    texts[7] = texts[299] = ""
    put(log, *(t + "\n" for t in texts), '{"half')
    want = [(i, t) for i, t in enumerate(texts) if t]
    monkeypatch.setattr(lines, "_PIECE", 100)
    for start in (0, 1, 8, 299, 300, 400):
        rows, end = lines.read_from(spark, str(log), start)
        assert end == 300 and sorted(map(tuple, rows.collect())) == want[sum(i < start for i, _ in want) :]
    file = lines._File({"path": str(log), "rangeBytes": 150})
    parts = file.ranges(0, 0, file.upto(0, 0, None)[1])
    assert len(parts) > 20 and [parts[0].first, *(p.end for p in parts[:-1])] == [p.first for p in parts]
    assert [(r, v) for p in parts for b in file.read(p) for r, v in zip(*(c.to_pylist() for c in b.columns), strict=True)] == want
    at, steps = (0, 0), 0
    while (then := file.upto(*at, 40)) != at:
        at, steps = then, steps + 1
    assert at[0] == 300 and steps > 100


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    log, n = tmp_path / "log.jsonl", 0

    def run():
        q = lines.stream(spark, str(log), start=2, maxBytes=400).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    for add in (50, 0, 3, 70):
        put(log, *(f'{{"n": {n + i}}}\n' for i in range(add)))
        n += add
        run()
        got = sorted((r.line, json.loads(r.value)["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [(i, i) for i in range(2, n)]


def test_a_file_that_was_cut_is_an_error(tmp_path):
    put(tmp_path / "x", "a\nb\n")
    with pytest.raises(ValueError, match="shorter"):
        lines._File({"path": str(tmp_path / "x")}).upto(9, 100, None)


PIECES = "kind string, seq long, text string"


def test_chunks_over_batches(spark, tmp_path):
    r = random.Random(2)
    pieces = [(r.choice(["a", "b", None]), i, r.choice(["", "x", "é" * 7, "long " * 11, None])) for i in range(240)]
    for k in range(3):
        spark.createDataFrame(pieces[k * 80 : (k + 1) * 80], PIECES).repartition(2).write.mode("append").json(str(tmp_path / "log"))
        events.drain_chunks(events.tail(spark, str(tmp_path / "log"), PIECES), str(tmp_path / "out"), str(tmp_path / "cp"), size=50)
    texts = {k: "".join(t or "" for own, _, t in pieces if own == k) for k in ("a", "b", None)}
    want = {(k, i // 50): t[i : i + 50] for k, t in texts.items() for i in range(0, len(t), 50)}
    assert {(x.kind, x.chunk): x.text for x in events.latest_chunks(spark, str(tmp_path / "out")).collect()} == want
    batch = spark.createDataFrame(pieces, PIECES)
    assert {(x.kind, x.chunk): x.text for x in events.chunks_between(batch, 0, 240, 50, block=37).collect()} == want
    some = {k: "".join(t or "" for own, i, t in pieces if own == k and 33 <= i < 150) for k in ("a", "b", None)}
    assert {(x.kind, x.chunk): x.text for x in events.chunks_between(batch, 33, 150, 50, block=37).collect()} == {(k, i // 50): t[i : i + 50] for k, t in some.items() for i in range(0, len(t), 50)}


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    write = events.once_per_batch(str(tmp_path / "out"))
    for number, n in ((0, 3), (1, 4), (1, 4), (0, 3)):
        write(spark.range(n), number)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    log = str(tmp_path / "log")
    df = spark.createDataFrame([("llm_delta", "x", 1)], "type string, text string, secret int")
    assert events.emit(df, log, once="7") and events.emit(df, log, once="7") and events.emit(df, log, once="8")
    assert spark.read.json(log).count() == 2 and "secret" not in spark.read.json(log).columns

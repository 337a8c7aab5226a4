"""Factorisation machine trained by minibatch Adam: parameters and moments stay in Spark, dealt to tasks by their codes.

An epoch is one barrier stage, whatever its number of minibatches: each task
holds the parameters of its codes and streams its share of every minibatch, in
an order drawn anew each epoch.  At a step the tasks ask one another for the
parameters that their rows need and send one another the gradients; these links
are the tasks' own, the driver is told where they listen and no more.  The state
of an epoch is a table in the shared folder, so a lost executor costs the epoch
that it was at.  The driver gets the parameters once, at the end, so
``max_parameters`` bounds them, a larger vocabulary is an error.  With
``folder`` the state of each epoch is kept there, and a fit that is started again
goes on from the last one.
"""

from __future__ import annotations

import itertools
import math
import secrets
import socket
import sys
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from multiprocessing import AuthenticationError
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.operators import metrics
from impressa.sources.shared import drop, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the library

#: Parameters that a driver or worker holds, with both moments about 24 bytes each on the driver.
MAX_PARAMETERS = 50_000_000
_TASK_ROWS = 65_536
#: Parameters, and rows of an epoch, that are worth a task of their own.
_SHARD_PARAMETERS = 500_000
_SHARD_ROWS = 1_000_000
_CHUNK = 4096  # codes whose parameters and moments a processor's cache holds
_STATE = "code long, w double, v array<double>, first array<double>, second array<double>"
_DECAY, _DECAY2, _EPSILON = 0.9, 0.999, 1e-8


def interaction(e: np.ndarray) -> np.ndarray:
    """Half of (|sum v|^2 - sum |v|^2), added up over the factors, for vectors of shape (rows, fields, factors)."""
    s = e.sum(axis=1)
    return ((s * s - (e * e).sum(axis=1)) / 2).sum(axis=1)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(at: np.ndarray, labels: np.ndarray, own: np.ndarray, b: float):
    """(gradients of own, weights beside vectors, the bias's, loss) of rows whose codes are at these places of own, added up over them."""
    e = own[at, 1:]
    p = logistic(b + own[at, 0].sum(axis=1) + interaction(e))
    g = p - labels
    each = g[:, None, None] * (e.sum(axis=1, keepdims=True) - e)
    flat = at.ravel()
    parts = [np.repeat(g, at.shape[1]), *(each[:, :, k].ravel() for k in range(own.shape[1] - 1))]
    loss = -(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)).sum()
    return np.stack([np.bincount(flat, x, len(own)) for x in parts], axis=1), float(g.sum()), float(loss)


def adam(own: np.ndarray, first: np.ndarray, second: np.ndarray, g: np.ndarray, step: int, lr: float, l2: float) -> None:
    """A step of Adam on weights beside vectors and both moments, in place; g is used up."""
    for at in range(0, len(own), _CHUNK):
        x, m, s, d = (a[at : at + _CHUNK] for a in (own, first, second, g))
        d += l2 * x
        m *= _DECAY
        m += (1 - _DECAY) * d
        s *= _DECAY2
        d *= (1 - _DECAY2) * d
        s += d
        np.divide(s, 1 - _DECAY2**step, out=d)
        np.sqrt(d, out=d)
        d += _EPSILON
        move = m / (1 - _DECAY**step)
        move *= lr
        move /= d
        x -= move


def initial(size: int, factors: int, seed: int, shard: int = 0, shards: int = 1) -> np.ndarray:
    """The vectors of every code, or of a shard's, drawn in the order of the codes."""
    draw, out = np.random.default_rng(seed), []
    for at in range(0, max(size, 1), _TASK_ROWS):
        out.append(draw.normal(0, 0.01, (min(_TASK_ROWS, size - at), factors))[(shard - at) % shards :: shards])
    return np.concatenate(out)


@dataclass
class State:
    """Parameters, moments and the step they are from."""

    v: np.ndarray
    w: np.ndarray
    b: float = 0.0
    first: np.ndarray = field(default=None)  # moments of (w, v), side by side
    second: np.ndarray = field(default=None)
    step: int = 0
    epoch: int = 0
    primary: float = float("nan")

    @classmethod
    def new(cls, size: int, factors: int, seed: int) -> State:
        return cls(initial(size, factors, seed), np.zeros(size), 0.0, np.zeros((size, factors + 1)), np.zeros((size, factors + 1)))

    @classmethod
    def of(cls, frame: DataFrame) -> State:
        table = frame.toArrow()
        head = table.filter(pc.less(table["code"], 0)).to_pylist()[0]
        table = table.filter(pc.greater_equal(table["code"], 0)).sort_by("code")
        v, first, second = (table[c].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1) for c in ("v", "first", "second"))
        step, epoch, primary = head["v"]
        return cls(v, table["w"].to_numpy(), head["w"], first, second, int(step), int(epoch), primary)

    def tables(self):
        """The state in the form of its table: code, w, v and both moments; code -1 has bias, step, epoch and the metric."""
        own = np.column_stack([self.w, self.v])
        yield from _tables(own, self.first, self.second, 0, 1)
        yield _head(self.b, self.step, self.epoch, self.primary)


def _codes(batch: pa.RecordBatch, fields: list[str], sizes: list[int]) -> np.ndarray:
    """Codes of all fields in one numbering; what a field does not know gets its last code."""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.stack([pc.fill_null(batch.column(f), -1).to_numpy(zero_copy_only=False) for f in fields], axis=1).astype(np.int64)
    return np.where((out >= 0) & (out < np.array(sizes)), out, np.array(sizes) - 1) + first


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x).ravel())


def _tables(own: np.ndarray, first: np.ndarray, second: np.ndarray, shard: int, shards: int):
    """Rows of the state's table for the codes shard, shard + shards and so on."""
    for at in range(0, len(own), _TASK_ROWS):
        x, m, s = (a[at : at + _TASK_ROWS] for a in (own, first, second))
        code = (np.arange(at, at + len(x), dtype=np.int64)) * shards + shard
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(x[:, 0].copy()), _lists(x[:, 1:]), _lists(m), _lists(s)], ["code", "w", "v", "first", "second"])


def _head(b: float, step: int, epoch: int, primary: float, loss: float = 0.0, rows: int = 0) -> pa.RecordBatch:
    lists = [pa.array([[float(y) for y in x]], pa.list_(pa.float64())) for x in ((step, epoch, primary), (loss, rows), ())]
    return pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([float(b)]), *lists], ["code", "w", "v", "first", "second"])


class _Links:
    """Connections of a task of a barrier stage to all others; ``meet`` sends each task its message and returns theirs, by number."""

    def __init__(self, context: BarrierTaskContext, key: bytes):
        infos = context.getTaskInfos()
        self.me, self.links, self.senders = context.partitionId(), [None] * len(infos), None
        if len(infos) == 1:
            return
        host = infos[self.me].address.rpartition(":")[0]
        with Listener((host, 0), backlog=len(infos), authkey=key) as listener:
            places = context.allGather(f"{host}:{listener.address[1]}")
            for k in range(self.me):
                where, _, port = places[k].rpartition(":")
                self.links[k] = Client((where, int(port)), authkey=key)
                self.links[k].send(self.me)
            while None in self.links[self.me + 1 :]:
                try:
                    link = listener.accept()
                except (AuthenticationError, EOFError, ConnectionError):
                    continue  # somebody else
                self.links[link.recv()] = link
        for link in filter(None, self.links):  # a message is written in two parts, the second is not to wait
            with socket.socket(fileno=socket.dup(link.fileno())) as own:
                own.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        self.senders = ThreadPoolExecutor(len(infos) - 1)

    def meet(self, messages: list) -> list:
        sent = [self.senders.submit(link.send, x) for link, x in zip(self.links, messages, strict=True) if link]
        got = [link.recv() if link else x for link, x in zip(self.links, messages, strict=True)]
        for x in sent:
            x.result()
        return got

    def close(self) -> None:
        for link in filter(None, self.links):
            link.close()
        if self.senders:
            self.senders.shutdown(wait=False)


def _runs(parts):
    """(place, values as a matrix) of each run of equal places, over any batches."""
    now, held = None, []
    for batch in parts:
        place, values = batch.column("place").to_numpy(), batch.column("values")
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
        for a, b in itertools.pairwise(cuts):
            if a == b:
                continue
            if held and place[a] != now:
                yield now, np.concatenate(held)
                held = []
            now = int(place[a])
            held.append(values.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1))
    if held:
        yield now, np.concatenate(held)


def _trained(parts, links: _Links, shards: int, batches: int, width: int, factors: int, lr: float, l2: float):
    """Tables of a shard after all minibatches; parts has bias and step, the shard, then the rows of each minibatch: label and codes."""
    runs = _runs(parts)
    b, step, epoch = next(runs)[1][0, :3]
    step, epoch, me, loss, count = int(step) + 1, int(epoch) + 1, links.me, 0.0, 0
    own, first, second = (np.zeros((0, factors + 1)) for _ in range(3))
    place, rows = next(runs, (batches, None))
    if place == -1:
        own, first, second = (np.ascontiguousarray(x) for x in np.split(rows, [factors + 1, 2 * factors + 2], axis=1))
        place, rows = next(runs, (batches, None))
    none = np.zeros(0, np.int64), np.zeros((0, factors + 1))
    sums, grads = (0, 0.0, 0.0), [none] * shards
    for now in range(batches + 1):
        codes, labels = np.zeros((0, width), np.int64), np.zeros(0)
        if place == now < batches:
            codes, labels = rows[:, 1:].astype(np.int64), rows[:, 0]
            place, rows = next(runs, (batches, None))
        seen, at = np.unique(codes, return_inverse=True)
        dealt = [np.flatnonzero(seen % shards == k) for k in range(shards)]
        met = links.meet([(sums, grads[k], seen[dealt[k]] // shards) for k in range(shards)])
        n = sum(x[0][0] for x in met)
        if n:
            g, gb = np.zeros_like(own), 0.0
            for (_, bias, more), (to, part), _ in met:
                g[to] += part / n
                gb, loss = gb + bias, loss + more
            adam(own, first, second, g, step, lr, l2)
            b, step, count = b - lr * gb / n, step + 1, count + n
        if now < batches:
            found = np.empty((len(seen), factors + 1))
            for k, answer in enumerate(links.meet([own[x[2]] for x in met])):
                found[dealt[k]] = answer
            g, gb, more = gradient(at.reshape(codes.shape), labels, found, b)
            sums, grads = (len(labels), gb, more), [(seen[x] // shards, g[x]) for x in dealt]
    yield from _tables(own, first, second, me, shards)
    if me == 0:
        yield _head(b, step - 1, epoch, math.nan, loss, count)


class MinibatchFM:
    """Fields are integer codes from 0, the last of each field for unknown values."""

    def __init__(self, fields: list[str], factors: int = 16, lr: float = 0.001, l2: float = 1e-6, batch_rows: int = 8192, epochs: int = 40, patience: int = 4, min_gain: float = 1e-5, seed: int = 0, max_parameters: int = MAX_PARAMETERS, tasks: int | None = None):
        self.fields, self.factors, self.lr, self.l2, self.batch_rows = list(fields), factors, lr, l2, batch_rows
        self.epochs, self.patience, self.min_gain, self.seed, self.max_parameters = epochs, patience, min_gain, seed, max_parameters
        self.tasks = tasks  # most tasks of an epoch, by default as many as the cluster runs at once
        self.sizes: list[int] = []
        self.losses: list[float] = []

    def _numbers(self):
        """An array of the codes of all fields in one numbering, in SQL."""
        first = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).tolist()
        known = [F.when((F.col(f) >= 0) & (F.col(f) < n), F.col(f)).otherwise(n - 1) for f, n in zip(self.fields, self.sizes, strict=True)]
        return F.array(*[(c + at).cast("long") for c, at in zip(known, first, strict=True)])

    def _tasks(self, spark: SparkSession, rows: int) -> int:
        """Tasks of an epoch; all of them must run at once."""
        n = math.ceil(max(sum(self.sizes) * (self.factors + 1) / _SHARD_PARAMETERS, rows / _SHARD_ROWS, min(rows, self.batch_rows) / _TASK_ROWS))
        most = self.tasks or spark.sparkContext.defaultParallelism // int(spark.conf.get("spark.task.cpus", "1"))
        return max(1, min(n, most))

    def fit(self, train: DataFrame, valid: DataFrame | None = None, row_id: str = "row_id", folder: str | None = None, state: State | None = None) -> State:
        """The state after the last epoch, or, with valid (user_id, row_id, label and fields), that of the best primary metric on it."""
        spark = train.sparkSession
        most = train.agg(*[F.max(f) for f in self.fields]).first()
        self.sizes = [(m if m is not None else -1) + 2 for m in most]
        if sum(self.sizes) * (self.factors + 1) > self.max_parameters:
            raise ValueError(f"{sum(self.sizes)} values with {self.factors} factors exceed max_parameters={self.max_parameters}: hash rare values of a field to fewer codes")
        base = f"{shared_folder(spark)}/fm-{uuid.uuid4().hex}"
        done = sorted((int(p.epoch), p.primary) for p in _epochs(spark, folder)) if folder else []
        best, since, epoch, primary = None, 0, 0, math.nan  # best: (epoch, its metric, its table)
        try:
            n = train.count()
            tasks, batches = self._tasks(spark, n), max(1, math.ceil(n / self.batch_rows))
            self._deal(train, row_id, batches, tasks).write.parquet(f"{base}/train")
            pieces = None if valid is None else self._ask(valid, row_id, base)
            if done:
                epoch, primary = done[-1]
                now = f"{folder}/epoch={epoch}"
                if valid is not None:
                    at, highest = max(done, key=lambda x: x[1])
                    best, since = (at, highest, f"{folder}/epoch={at}"), epoch - at
            else:
                now = f"{base}/state-0"
                self._start(spark, state, tasks).write.parquet(now)
                if state is not None:
                    epoch, primary = state.epoch, state.primary
                    best = None if valid is None else (epoch, primary, now)
            while epoch < self.epochs and (valid is None or since < self.patience):
                epoch += 1
                before, now = now, f"{base}/state-{epoch}"
                self._epoch(spark, before, now, base, batches, tasks, epoch)
                if before.startswith(base) and (best is None or best[2] != before):
                    drop(spark, before)
                loss, rows = spark.read.parquet(now).where("code = -1").first()["first"]
                self.losses.append(loss / rows if rows else math.nan)
                if valid is not None:
                    found = metrics.ranking_metrics(self._scored(spark, now, base, pieces, valid, row_id)).first().primary_score
                    primary = -math.inf if found is None else found
                    if best is None or not best[1] + self.min_gain >= primary:
                        if best is not None and best[2].startswith(base):
                            drop(spark, best[2])
                        best, since = (epoch, primary, now), 0
                    else:
                        since += 1
                if folder:
                    kept = F.when(F.col("code") < 0, F.array(F.get("v", F.lit(0)), F.get("v", F.lit(1)), F.lit(float(primary)))).otherwise(F.col("v"))
                    spark.read.parquet(now).withColumn("v", kept).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
            _, primary, now = best or (epoch, primary, now)
            out = State.of(spark.read.parquet(now))
            out.primary = primary
            return out
        finally:
            drop(spark, base)

    def _deal(self, train: DataFrame, row_id: str, batches: int, tasks: int) -> DataFrame:
        """(batch, piece, at, values: label and codes): rows dealt to minibatches and tasks, ``at`` orders them."""
        h = F.xxhash64(F.col(row_id), F.lit(self.seed))
        batch, piece = F.pmod(h, F.lit(batches)), F.pmod(F.xxhash64(h), F.lit(tasks))
        return train.select(batch.cast("int").alias("batch"), piece.cast("int").alias("piece"), h.alias("at"), F.concat(F.array(F.col("label").cast("double")), self._numbers().cast("array<double>")).alias("values"))

    def _start(self, spark: SparkSession, state: State | None, tasks: int) -> DataFrame:
        if state is not None:
            return spark.createDataFrame(pa.Table.from_batches([*state.tables()]), _STATE)
        size, factors, seed = sum(self.sizes), self.factors, self.seed

        def new(parts):
            for k in itertools.chain.from_iterable(x.column(0).to_pylist() for x in parts):
                v = initial(size, factors, seed, k, tasks)
                own = np.column_stack([np.zeros(len(v)), v])
                yield from _tables(own, np.zeros_like(own), np.zeros_like(own), k, tasks)
                if k == 0:
                    yield _head(0.0, 0, 0, math.nan)

        return spark.range(0, tasks, 1, tasks).mapInArrow(new, _STATE)

    def _epoch(self, spark: SparkSession, before: str, after: str, base: str, batches: int, tasks: int, epoch: int) -> None:
        """Writes the state after all minibatches once, in an order of this epoch."""
        order = np.random.default_rng((self.seed, epoch)).permutation(batches).astype(np.int32)
        places = spark.createDataFrame(pa.table({"batch": order, "place": np.arange(batches, dtype=np.int32)}))
        rows = spark.read.parquet(f"{base}/train").join(F.broadcast(places), "batch").select("piece", "place", "at", "values")
        head, values = F.col("code") < 0, F.concat(F.array("w"), "v", "first", "second")
        to = F.when(head, F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array((F.col("code") % tasks).cast("int")))
        state = spark.read.parquet(before).select(F.explode(to).alias("piece"), F.when(head, -2).otherwise(-1).alias("place"), F.col("code").alias("at"), values.alias("values"))
        key, width, factors, lr, l2 = secrets.token_bytes(), len(self.fields), self.factors, self.lr, self.l2

        def run(parts):
            links = _Links(BarrierTaskContext.get(), key)
            try:
                yield from _trained(parts, links, tasks, batches, width, factors, lr, l2)
            finally:
                links.close()

        dealt = state.unionByName(rows).repartitionById(tasks, "piece").sortWithinPartitions("place", "at").select("place", "values")
        dealt.mapInArrow(run, _STATE, barrier=True).write.parquet(after)

    def _ask(self, valid: DataFrame, row_id: str, base: str) -> int:
        """Writes the rows to be scored, in pieces that share few codes, and the codes that each piece needs; the number of pieces."""
        spark, pieces = valid.sparkSession, max(1, math.ceil(valid.count() / _TASK_ROWS))
        rows = valid.select(*dict.fromkeys(["user_id", row_id, "label"]), self._numbers().alias("_codes"))
        most = F.get("_codes", F.lit(int(np.argmax(self.sizes))))
        rows.repartitionByRange(pieces, most, F.col(row_id)).withColumn("_piece", F.spark_partition_id()).write.parquet(f"{base}/valid")
        codes = F.explode(F.concat(F.array(F.lit(-1).cast("long")), "_codes"))
        spark.read.parquet(f"{base}/valid").select("_piece", codes.alias("_code")).distinct().write.parquet(f"{base}/asked")
        found = spark.read.parquet(f"{base}/asked").agg(F.max("_piece")).first()[0]
        return 1 if found is None else found + 1

    def _scored(self, spark: SparkSession, now: str, base: str, pieces: int, rows: DataFrame, row_id: str) -> DataFrame:
        """user_id, row_id and label of the rows with score, as ``predict`` gives it."""
        own = F.when(F.col("code") < 0, F.array("w")).otherwise(F.concat(F.array("w"), "v"))
        state = spark.read.parquet(now).select(F.col("code").alias("_code"), own.alias("_own"))
        answers = spark.read.parquet(f"{base}/asked").join(state.hint("merge"), "_code")  # not by way of the driver
        both = answers.unionByName(spark.read.parquet(f"{base}/valid"), allowMissingColumns=True)
        names, width, factors = list(dict.fromkeys(["user_id", row_id, "label"])), len(self.fields), self.factors

        def score(parts):
            found, held, b = [], [], 0.0
            for batch in parts:
                known = batch.num_rows - batch.column("_code").null_count
                if known:  # codes and their parameters come before the rows, the bias first
                    code, own = batch.column("_code").slice(0, known).to_numpy(), batch.column("_own").slice(0, known).flatten().to_numpy()
                    if code[0] < 0:
                        b, code, own = own[0], code[1:], own[1:]
                    found, held = [*found, code], [*held, own.reshape(-1, factors + 1)]
                if known == batch.num_rows:
                    continue
                if len(found) > 1:
                    found, held = [np.concatenate(found)], [np.concatenate(held)]
                batch = batch.slice(known)
                at = np.searchsorted(found[0], batch.column("_codes").flatten().to_numpy().reshape(-1, width))
                own = held[0][at]
                scores = b + own[:, :, 0].sum(axis=1) + interaction(own[:, :, 1:])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores)], [*names, "score"])

        kinds = dict(rows.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double"
        return both.repartitionById(pieces, "_piece").sortWithinPartitions(F.asc_nulls_last("_code")).mapInArrow(score, schema)

    def predict(self, state: State, rows: DataFrame) -> DataFrame:
        """rows with score, the logit; scored in Arrow batches with the parameters as arrays."""
        held, kept = rows.sparkSession.sparkContext.broadcast((state.v, state.w, state.b)), [c for c in rows.columns if c != "score"]
        fields, sizes = self.fields, self.sizes

        def run(parts):
            v, w, b = held.value
            for batch in parts:
                codes = _codes(batch, fields, sizes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b + w[codes].sum(axis=1) + interaction(v[codes]))], [*batch.schema.names, "score"])

        rows = rows.select(*kept)
        return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", score double")


def _epochs(spark: SparkSession, folder: str):
    """(epoch, primary) of the epochs whose states are whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    paths = [p.getPath().getParent().toString() for p in found or []]
    return spark.read.parquet(*paths).where("code = -1").select(F.get("v", F.lit(1)).alias("epoch"), F.get("v", F.lit(2)).alias("primary")).collect() if paths else []


def scores(rows: DataFrame, fields: list[str], parameters: DataFrame, bias: float, row_id: str = "row_id", max_parameters: int = MAX_PARAMETERS) -> DataFrame:
    """row_id, score = bias + sum w + (|sum v|^2 - sum |v|^2) / 2 over the row's field values.

    parameters: field, value, w, v (array); unknown values add nothing.  Up to
    ``max_parameters`` numbers are broadcast as arrays, more are joined by value.
    """
    found = parameters.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("k")).first()
    texts = [F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]
    if (found.n or 0) * ((found.k or 0) + 1) > max_parameters:
        return _joined(rows, fields, parameters, bias, row_id)
    table = parameters.toArrow()
    per = []
    for f in fields:
        own = table.filter(pc.equal(table["field"], f)).combine_chunks()
        v = np.array(own["v"].to_pylist(), float).reshape(own.num_rows, found.k or 0)
        per.append((own["value"].combine_chunks(), np.append(own["w"].to_numpy(), 0.0), np.vstack([v, np.zeros((1, found.k or 0))])))
    held = rows.sparkSession.sparkContext.broadcast(per)

    def run(batches):
        for batch in batches:
            at = [pc.fill_null(pc.index_in(batch.column(i + 1), value_set=values), len(values)).to_numpy() for i, (values, _, _) in enumerate(held.value)]
            linear = np.sum([w[a] for a, (_, w, _) in zip(at, held.value, strict=True)], axis=0)
            pairs = interaction(np.stack([v[a] for a, (_, _, v) in zip(at, held.value, strict=True)], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bias + linear + pairs)], [row_id, "score"])

    return rows.select(row_id, *texts).mapInArrow(run, f"`{row_id}` {dict(rows.dtypes)[row_id]}, score double")


def _joined(rows: DataFrame, fields: list[str], parameters: DataFrame, bias: float, row_id: str) -> DataFrame:
    """The same by a join on (field, value): parameters stay partitioned, vectors are added up as arrays."""
    long = rows.select(row_id, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(row_id, "x.field", "x.value")
    per = long.join(parameters, ["field", "value"], "left").groupBy(row_id).agg(F.sum("w").alias("w"), F.collect_list("v").alias("v"))

    def added(squared):
        return F.aggregate(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), squared(F.get("v", F.lit(0))), lambda a, x: F.zip_with(a, squared(x), lambda p, q: p + q))

    sums, squares = added(lambda x: x), added(lambda x: F.transform(x, lambda y: y * y))
    pairs = F.aggregate(F.zip_with(sums, squares, lambda s, q: (s * s - q) / 2), F.lit(0.0), lambda a, x: a + x)
    return per.select(row_id, (F.lit(float(bias)) + F.coalesce("w", F.lit(0.0)) + F.when(F.size("v") > 0, pairs).otherwise(0.0)).alias("score"))

"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, where cosine >= c means distance <= epsilon =
sqrt(2 - 2c).  They are projected on the leading principal directions and sorted
by their epsilon-wide grid cells in lexicographic (epsilon grid) order; the
sequence is cut into blocks with bounding boxes.  A tree of sequence intervals
over the blocks is joined with itself level by level: a pair of intervals whose
boxes are further apart than epsilon is provably without links and is skipped,
the others pass to their halves.  Surviving block pairs are compared exactly in
double precision.

Exact copies are joined once, weighted by their number.  Pairs are never
emitted: a block pair returns a link count and one spanning edge per vector.

Block pairs are dealt in tiles of neighbouring blocks: a tile is sent each of
its blocks once, however many of its pairs survive.

Vectors of different lengths never link; each length is joined by itself.  Null
or zero vectors and those with null or non-finite components link with nothing
and keep n_links 0, as do rows with a null vec_id, which keep a null component;
an empty table gives no rows; repeated vec_ids are rows of their own with a
common component; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impressa.llm.components import components
from impressa.llm.shared import cut, trimmed

COSINE = 0.95
BLOCK = 1024
LEADING = 8
FANOUT = 8
TILE = 8  # blocks of a side
_BLOCKS = "part int, seq int, lo array<double>, hi array<double>, ids array<long>, weights array<long>, data binary"


def _valid(v):
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _unit(c: str):
    """The vector at length 1; what a lambda names is computed for each of its elements, so the norm is handed to it."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return F.zip_with(c, F.array_repeat(norm, F.size(c)), lambda x, n: x.cast("double") / n)


def _blocks(rows: DataFrame, directions: np.ndarray, eps: float, size: int, kind) -> DataFrame:
    """Sorted blocks of the epsilon grid order: bounding box, ids, weights and vectors."""
    k = directions.shape[1]

    @trimmed
    def project(batches):
        for batch in batches:
            v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            y = (v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]) @ directions
            cells = pa.array(list(np.floor(y / eps).astype(np.int32)), pa.list_(pa.int32()))
            yield batch.append_column("cells", cells).append_column("y", pa.array(list(y), pa.list_(pa.float64())))

    @trimmed
    def block(batches):
        held, n, seq = [], 0, 0
        part = _part()

        def emit(table):
            y = np.array(table.column("y").to_pylist()).reshape(table.num_rows, k)
            data = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([y.min(0)], pa.list_(pa.float64())), pa.array([y.max(0)], pa.list_(pa.float64())), pa.array([table.column("rep").to_pylist()], pa.list_(pa.int64())), pa.array([table.column("n").to_pylist()], pa.list_(pa.int64())), pa.array([data.tobytes()])],
                ["part", "seq", "lo", "hi", "ids", "weights", "data"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield emit(table.slice(0, size))
                seq += 1
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield emit(pa.Table.from_batches(held))

    projected = rows.mapInArrow(project, f"embedding {rows.schema['embedding'].dataType.simpleString()}, rep long, n long, cells array<int>, y array<double>")
    return projected.repartitionByRange(*[F.element_at("cells", i + 1) for i in range(k)], "rep").sortWithinPartitions("cells", "rep").mapInArrow(block, _BLOCKS)


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b) of blocks whose boxes are within eps, by descending a tree of sequence intervals."""
    nodes = [cut(blocks.select(F.col("block").alias("node"), "lo", "hi"))]

    def extreme(f, c):
        return F.array(*[f(F.element_at(c, i + 1)) for i in range(_leading(nodes[0]))])

    while nodes[-1].count() > 1:
        up = nodes[-1].groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("node")).agg(extreme(F.min, "lo").alias("lo"), extreme(F.max, "hi").alias("hi"))
        nodes.append(cut(up))
    gaps = F.zip_with(F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda t, x: t + x * x) <= eps * eps
    pairs = nodes[-1].select(F.col("node").alias("pa"), F.col("node").alias("pb"))  # the root with itself
    for level in reversed(nodes[:-1]):
        child = level.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long"))
        a, b = child.alias("a"), child.alias("b")
        pairs = cut(pairs.join(a, F.col("pa") == F.col("a.parent")).join(b, (F.col("pb") == F.col("b.parent")) & (F.col("a.node") <= F.col("b.node")) & near).select(F.col("a.node").alias("pa"), F.col("b.node").alias("pb")))
    return pairs


def _leading(blocks: DataFrame) -> int:
    row = blocks.select(F.size("lo").alias("k")).first()
    return row.k if row else 0


def _links(a, b, same: bool, cosine: float):
    """Link counts (weighted) and local component roots of the vectors of a block pair."""
    x, ia, wa = a
    y, ib, wb = b
    hit = (x @ y.T) >= cosine
    if same:
        np.fill_diagonal(hit, False)
    on_a, on_b = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    hit = hit[np.ix_(on_a, on_b)]  # most vectors of a block pair have no link in it
    na, nb = np.einsum("ij,j->i", hit, wb[on_b]), np.einsum("i,ij->j", wa[on_a], hit)
    la, lb = ia[on_a].copy(), ib[on_b].copy()
    far = np.iinfo(np.int64).max
    while len(la):
        new_b = np.minimum(lb, np.where(hit, la[:, None], far).min(0))
        new_a = np.minimum(la, np.where(hit, new_b[None, :], far).min(1))
        if (new_a == la).all() and (new_b == lb).all():
            break
        la, lb = new_a, new_b
    if same:
        return ia[on_a], na, np.minimum(la, lb)
    return np.concatenate([ia[on_a], ib[on_b]]), np.concatenate([na, nb]), np.concatenate([la, lb])


def _same_length(groups: DataFrame, dim: int, kind, cosine: float, block: int, leading: int) -> DataFrame:
    """(embedding, links, component) of distinct vectors of one length, each with its smallest id and number of copies."""
    spark = groups.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-6) + 1e-9)
    unit = groups.select(array_to_vector(_unit("embedding")).alias("v"))
    directions = PCA(k=min(leading, dim), inputCol="v", outputCol="p").fit(unit).pc.toArray()

    made = cut(_blocks(groups, directions, eps, block, kind))
    order = Window.orderBy("part", "seq")  # of the blocks' numbers only: one row per BLOCK vectors
    numbers = cut(made.select("part", "seq").select("part", "seq", (F.row_number().over(order) - 1).cast("long").alias("block")))
    blocks = made.join(numbers, ["part", "seq"])
    pairs = _block_pairs(blocks.select("block", "lo", "hi"), eps)
    tiles = cut(pairs.groupBy(F.floor(F.col("pa") / TILE).alias("ta"), F.floor(F.col("pb") / TILE).alias("tb")).agg(F.collect_list(F.struct("pa", "pb")).alias("pairs")))
    needs = tiles.select("ta", "tb", "pairs", F.explode(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["pa"], p["pb"]))))).alias("block"))
    sent = needs.join(blocks.select("block", "ids", "weights", "data"), "block")
    width = max(1, min(tiles.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    @trimmed
    def compare(batches):
        for rows in _tiles(batches):
            held = {}
            for r in rows:
                v = np.frombuffer(r["data"], kind).astype(np.float64).reshape(-1, dim)
                held[r["block"]] = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], np.array(r["ids"]), np.array(r["weights"])
            for p in rows[0]["pairs"]:
                ids, counts, roots = _links(held[p["pa"]], held[p["pb"]], p["pa"] == p["pb"], cosine)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(roots, pa.int64())], ["rep", "links", "root"])

    found = cut(sent.repartition(width, "ta", "tb").sortWithinPartitions("ta", "tb").select("ta", "tb", "block", "pairs", "ids", "weights", "data").mapInArrow(compare, "rep long, links long, root long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found, "rep", "root")
    return groups.join(counts, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))


def _tiles(batches):
    """Lists of the rows of one tile; rows come sorted by tile."""
    held = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if held and (row["ta"], row["tb"]) != (held[0]["ta"], held[0]["tb"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK, leading: int = LEADING) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    of = vectors.schema[vec_col].dataType.elementType.simpleString()
    of, kind = ("float", np.float32) if of == "float" else ("double", np.float64)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{of}>").alias("embedding"))
    ok = F.coalesce(_valid(F.col("embedding")), F.lit(False)) & F.col("vec_id").isNotNull()
    # adding 0 makes one zero of both
    rows = rows.withColumn("embedding", F.when(ok, F.transform("embedding", lambda x: x + F.lit(0.0).cast(of))))
    groups = cut(rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    found = [_same_length(groups.where(F.size("embedding") == r.d), r.d, kind, cosine, block, leading) for r in groups.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # by hash, then value by value: as a key of the join, a vector of floats would be normalised again at each comparison of the sort
    key = reduce(DataFrame.unionAll, found).withColumnRenamed("embedding", "_e").withColumn("_h", F.xxhash64("_e"))
    rows = rows.withColumn("h", F.when(F.col("embedding").isNull(), F.xxhash64("vec_id")).otherwise(F.xxhash64("embedding")))
    equal = (F.col("h") == F.col("_h")) & (F.col("embedding") <= F.col("_e")) & (F.col("embedding") >= F.col("_e"))
    return rows.join(key, equal, "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

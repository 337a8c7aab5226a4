"""Merkle manifest of a table: a leaf a row, a tree a source, a tree over the sources.

Every three consecutive nodes become the sha256 of their digests, level by
level; a last run of one or two is hashed as well.  Rows are placed by a range
shuffle on (source, identifier), so a source of any size is spread, and
numbered from the counts of the ranges.  Blocks are aligned: ``BLOCK`` = 3**6
consecutive leaves of a source share all nodes of six levels, so each block's
tree is built alone.  Executors do that in DuckDB, over Arrow tables of whole
blocks: a level is one ordered ``string_agg`` with ``sha256``.  Spark combines
the blocks' roots, 81 at a time, then the sources' roots, and joins the proofs
above a block to the leaves.  A task holds some 16,000 leaves; nothing goes
through the driver but the number of nodes of the largest source.

Ties: rows are ordered by source (null first, UTF-8 bytewise), identifier (null
first), then leaf; equal rows have equal leaves, so any order of them gives the
same tree.  A null field is ``-``, an empty text ``0:``.  Texts of any length
are hashed whole in the JVM and never shuffled.  Further columns, whatever
their names, are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.llm.shared import cut, trimmed

#: Levels that DuckDB builds in one block, and that Spark builds in one group.
BLOCK_LEVELS, GROUP_LEVELS = 6, 4
BLOCK, GROUP = 3**BLOCK_LEVELS, 3**GROUP_LEVELS
_HELD = 16_384
#: Rows of a table that is broadcast; each has at most a few kilobytes.
MAX_BROADCAST = 8_192
_PATH = "array<struct<left: string, right: string>>"


def leaf(*values: Column) -> Column:
    """Digest of a row: each value ``-`` if null, else its byte count, ``:`` and the value."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)), 256)


def levels(n: Column) -> Column:
    """Levels above n nodes."""
    return F.size(F.filter(F.array(*(F.lit(3**k).cast("long") for k in range(40))), lambda x: x < n))


def _with_small(many: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Joined with a table of one row per key, broadcast where its counted rows are few."""
    return many.join(F.broadcast(few) if few.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else few, on)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (written; with ``key``) with ``p``, their place within the key, and ``n``, the key's rows."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(width, "key", *order, "_tie").sortWithinPartitions("key", *order).drop("_tie")
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = placed.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    own = Window.partitionBy("key")
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.select("key", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(own).alias("n")))
    return _with_small(placed, counts, ["key", "_part"]).withColumn("p", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _block_trees(con, table: pa.Table) -> pa.Table:
    """``table`` (whole blocks of key, p, n, leaf in order) with ``path``, the siblings of each level, and ``top``, the block's root."""
    p, n = (table.column(c).to_numpy() for c in ("p", "n"))
    depth = np.minimum(BLOCK_LEVELS, (n[:, None] > 3 ** np.arange(40, dtype=np.int64)[None, :BLOCK_LEVELS]).sum(axis=1))
    nodes = pa.table({"g": np.cumsum(p % BLOCK == 0), "q": p % BLOCK, "d": depth, "h": table.column("leaf")})
    con.register("given", nodes)
    con.execute("create or replace temp table level0 as select * from given")
    for k in range(BLOCK_LEVELS):
        con.execute(f"""create or replace temp table beside{k} as
            select g, q, {{'left': coalesce(lag(h, 2) over w, '') || coalesce(lag(h) over w, ''), 'right': coalesce(lead(h) over w, '') || coalesce(lead(h, 2) over w, '')}} as s
            from level{k} where d > {k} window w as (partition by g, q // 3 order by q)""")
        con.execute(f"""create or replace temp table level{k + 1} as
            select g, q // 3 as q, any_value(d) as d, sha256(string_agg(h, '' order by q)) as h from level{k} where d > {k} group by g, q // 3
            union all select g, q, d, h from level{k} where d <= {k}""")
    joins = " ".join(f"left join beside{k} on beside{k}.g = level0.g and beside{k}.q = level0.q // {3**k}" for k in range(BLOCK_LEVELS))
    made = con.sql(f"""select list_filter([{', '.join(f'beside{k}.s' for k in range(BLOCK_LEVELS))}], lambda x: x is not null) as path, t.h as top
        from level0 join level{BLOCK_LEVELS} t on t.g = level0.g {joins} order by level0.g, level0.q""").to_arrow_table()
    con.unregister("given")
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    return table.append_column("path", made.column("path").cast(kind)).append_column("top", made.column("top").cast(pa.string()))


def blocks(nodes: DataFrame) -> DataFrame:
    """nodes (key, p, n, leaf and what else there is) with the ``path`` within their block, the number of the ``block`` and its ``top``."""
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = nodes.withColumn("block", F.expr(f"p div {BLOCK}")).repartition(width, "key", "block").sortWithinPartitions("key", "p")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields] + [f"path {_PATH}", "top string"])

    @trimmed
    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _HELD:
                table = pa.Table.from_batches(held).combine_chunks()
                last = int(np.flatnonzero(table.column("p").to_numpy() % BLOCK == 0)[-1])
                if last:
                    yield from _block_trees(con, table.slice(0, last)).to_batches()
                held = table.slice(last).to_batches()
                rows -= last
        if rows:
            yield from _block_trees(con, pa.Table.from_batches(held)).to_batches()

    return whole.mapInArrow(run, schema)


def _joined(digests: Column) -> Column:
    """The level above an array of digests."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / 3).cast("int")), lambda i: F.sha2(F.array_join(F.slice(digests, 3 * i + 1, 3), ""), 256))


def combine(nodes: DataFrame) -> DataFrame:
    """key, p, path and top of nodes (key, p, n, h): one tree a key, built by groups of 81 nodes."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return nodes.select("key", "p", F.array().cast(_PATH).alias("path"), F.col("h").alias("top"))
    own = nodes.groupBy("key", "n", F.expr(f"p div {GROUP}").alias("_group")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]).alias("_a0")).withColumn("_d", levels(F.col("n")))
    beside = []
    for k in range(GROUP_LEVELS):
        a = F.col(f"_a{k}")
        own = own.withColumn(f"_a{k + 1}", F.when(F.col("_d") > k, _joined(a)).otherwise(a))
        at = F.expr(f"cast(_j div {3**k} as int)")
        left, right = F.slice(a, at - at % 3 + 1, at % 3), F.slice(a, at + 2, 2 - at % 3)
        beside.append(F.when(F.col("_d") > k, F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))))
    each = own.select("*", F.posexplode(F.col("_a0")).alias("_j", "_h"))
    each = each.select("key", "n", "_group", (F.col("_group") * GROUP + F.col("_j")).alias("p"), F.filter(F.array(*beside), lambda x: x.isNotNull()).alias("path"), F.get(f"_a{GROUP_LEVELS}", F.lit(0)).alias("top"))
    if most <= GROUP:
        return each.select("key", "p", "path", "top")
    each = cut(each)
    above = combine(each.where(F.col("p") % GROUP == 0).select("key", F.col("_group").alias("p"), F.expr(f"(n + {GROUP - 1}) div {GROUP}").alias("n"), F.col("top").alias("h")))
    return each.drop("top").join(above.select("key", F.col("p").alias("_group"), F.col("path").alias("_more"), "top"), ["key", "_group"]).select("key", "p", F.concat("path", "_more").alias("path"), "top")


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", **others: Column) -> DataFrame:
    """doc_id, leaf, subroot, root and path (left and right siblings of each level up to the root) of each row; others: further digests to carry along."""
    key = F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string")))
    narrow = cut(docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), leaf(*(F.col(f) for f in fields)).alias("leaf"), *(c.alias(f"other_{name}") for name, c in others.items())))
    inner = cut(blocks(numbered(narrow, ["doc_id", "leaf"])))
    roots = inner.where(F.col("p") % BLOCK == 0).select("key", F.col("block").alias("p"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("h"))
    within = cut(combine(cut(roots)))
    tops = within.where("p = 0").select("key", F.col("top").alias("h"))
    ranked = numbered(cut(tops.select(F.lit("").alias("key"), F.col("key").alias("source"), "h")), ["source"])
    over = combine(ranked).join(ranked.select("p", "source"), "p").select(F.col("source").alias("key"), F.col("path").alias("_last"), F.col("top").alias("root"))
    outer = cut(_with_small(within, cut(over), ["key"]).select("key", F.col("p").alias("block"), F.concat("path", "_last").alias("_outer"), F.col("top").alias("subroot"), "root"))
    return _with_small(inner.drop("top"), outer, ["key", "block"]).select("doc_id", "leaf", "subroot", "root", F.concat("path", "_outer").alias("path"), *(F.col(f"other_{name}").alias(name) for name in others))


def fold(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path give."""
    return F.aggregate(path, digest, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings, level by level, from left to right."""
    return F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"])))

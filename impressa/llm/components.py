"""Connected components by contraction to the smallest neighbour.

Each round points every node to the smallest node among itself and its
neighbours, follows the pointers to their tops (a step doubles the distance
covered, so a chain of n nodes takes log n steps) and contracts the edges.
Only nodes without a smaller neighbour stay, and of these only tops of others
outlast the next round: two rounds at least halve the nodes.  Edges never leave
the executors; each step's table is written to the shared folder and read back.
A checkpoint would not do: it keeps the constraints of its plan, which multiply
from step to step until planning takes longer than the work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.shared import shared_dir


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _tops(parent: DataFrame) -> DataFrame:
    """(node, parent) with every pointer followed to its end."""
    while True:
        up = parent.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        step = _written(parent.join(up, F.col("parent") == F.col("_n")).select("node", F.col("_p").alias("parent"), (F.col("_p") < F.col("parent")).alias("moved")))
        parent = step.select("node", "parent")
        if step.where("moved").isEmpty():
            return parent


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Null ends and loops are ignored; repeated edges count once; no edges give
    no rows.
    """
    edges = _written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = _written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")))
        parent = _tops(parent)
        maps.append(parent)
        up = edges.join(parent, F.col("a") == F.col("node")).select(F.col("parent").alias("pa"), "b")
        up = up.join(parent, F.col("b") == F.col("node")).select("pa", F.col("parent").alias("pb")).where("pa <> pb")
        edges = _written(up.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select("node", F.col("parent").alias("component"))
    for later in maps[1:]:
        step = later.select(F.col("node").alias("_n"), "parent")
        out = out.join(step, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("parent", "component").alias("component"))
    return _written(out)

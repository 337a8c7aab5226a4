"""Gradient-boosted trees on ranking gradients: lambdas per user, histograms summed in Spark, splits chosen from a bounded table.

A pair of a positive and a negative row of one user counts by how much nDCG@k
would change if they changed places.  Only a row among the user's first k can
change it, so each row is compared with k rows at most: rows get the first k of
their user, their own gradients follow from these, and those of the first k are
sums over the user's rows, added up before they are shuffled.

Features are cut to at most ``bins`` bins by train quantiles.  For each level of
a tree tasks add up gradients by node, feature and bin; that table has
2**depth * features * bins rows at most, and the driver chooses the splits from
it.  Null features go to the lowest bin.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.operators import features as feature
from impressa.sources.shared import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the library


def _discount(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0)


def lambdas(rows: DataFrame, k: int = 5, user: str = "user_id", row_id: str = "row_id") -> DataFrame:
    """(row_id, g, h): first and second derivatives of the pairwise loss with respect to each row's score.

    rows has user, row_id, label (0 or 1) and score; ranks are by score, then
    row_id.  Users without both labels have gradients of 0.
    """
    order = Window.partitionBy(user).orderBy(F.desc("score"), row_id)
    first = rows.select(user, row_id, "label", "score", F.row_number().over(order).alias("r")).where(F.col("r") <= k)  # Spark limits each partition before the shuffle
    first = first.groupBy(F.col(user).alias("_u")).agg(F.array_sort(F.collect_list(F.struct("r", F.col(row_id).alias("id"), "label", "score"))).alias("_top"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_p"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    users = rows.groupBy(F.col(user).alias("_w")).agg(F.sum("label").alias("_p"), F.count(F.lit(1)).alias("_n")).where((F.col("_p") > 0) & (F.col("_p") < F.col("_n")))
    known = first.join(users, F.col("_u") == F.col("_w")).select("_u", "_top", ideal.alias("_ideal"))
    own = rows.join(known, F.col(user) == F.col("_u")).withColumn("_r", F.coalesce(F.aggregate("_top", F.lit(None).cast("int"), lambda a, t: F.coalesce(a, F.when(t["id"] == F.col(row_id), t["r"]))), F.lit(k + 1)))

    def pair(t):
        """What the row and one of the first k add to each other's derivatives; each pair of two of the first is seen from both."""
        sign = F.when(F.col("label") > t["label"], 1.0).when(F.col("label") < t["label"], -1.0).otherwise(0.0)
        p = 1 / (1 + F.exp(sign * (F.col("score") - t["score"])))
        weight = F.abs(_discount(F.col("_r"), k) - _discount(t["r"], k)) / F.col("_ideal")
        return F.struct(t["id"].alias("id"), (-sign * p * weight).alias("g"), (F.abs(sign) * p * (1 - p) * weight).alias("h"), (F.col("_r") > k).alias("far"))

    own = own.select(F.col(row_id).alias("_id"), F.transform("_top", pair).alias("x"))
    mine = own.select("_id", F.aggregate("x", F.lit(0.0), lambda a, x: a + x["g"]).alias("g"), F.aggregate("x", F.lit(0.0), lambda a, x: a + x["h"]).alias("h"))
    theirs = own.select(F.explode(F.filter("x", lambda x: x["far"])).alias("x")).select(F.col("x.id").alias("_id"), (-F.col("x.g")).alias("g"), F.col("x.h").alias("h"))
    found = mine.unionByName(theirs).groupBy("_id").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return rows.select(row_id).join(found, F.col(row_id) == F.col("_id"), "left").select(row_id, F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("h", F.lit(0.0)).alias("h"))


@dataclass
class Tree:
    """Nodes by number: children of n are 2n + 1 and 2n + 2; a split sends bins up to its own to the left."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def node(self, bins: Column, levels: int) -> Column:
        """The node of a row after so many levels."""
        at = F.lit(0)
        for n in sorted(self.splits):
            if n < 2**levels - 1:
                f, b = self.splits[n]
                at = F.when(at == n, F.when(F.get(bins, F.lit(f)) <= b, 2 * n + 1).otherwise(2 * n + 2)).otherwise(at)
        return at

    def value(self, bins: Column, depth: int) -> Column:
        at = self.node(bins, depth)
        return F.coalesce(*[F.when(at == n, v) for n, v in self.leaves.items()], F.lit(0.0)) if self.leaves else F.lit(0.0)


def histogram(rows: DataFrame, nodes: int, width: int, bins: int) -> DataFrame:
    """(node, feature, bin, g, h, n) of rows (node, bins, g, h): a row per cell and task is shuffled."""

    def add(batches):
        total = np.zeros((3, nodes * width * bins))
        for batch in batches:
            node = batch.column("node").to_numpy()
            codes = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(len(node), width)
            cell = ((node[:, None] * width + np.arange(width)) * bins + codes).ravel()
            for i, c in enumerate(("g", "h")):
                total[i] += np.bincount(cell, np.repeat(batch.column(c).to_numpy(), width), nodes * width * bins)
            total[2] += np.bincount(cell, minlength=nodes * width * bins)
        at = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(at // (width * bins)), pa.array(at // bins % width), pa.array(at % bins), *(pa.array(t[at]) for t in total)], ["node", "feature", "bin", "g", "h", "n"])

    return rows.select("node", "bins", "g", "h").mapInArrow(add, "node long, feature long, bin long, g double, h double, n double").groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])


class LambdaRank:
    """``fit`` gives trees; ``predict`` adds ``score``, the sum of their leaves times the learning rate."""

    def __init__(self, fields: list[str], trees: int = 20, depth: int = 3, bins: int = 32, lr: float = 0.1, l2: float = 1.0, min_rows: int = 20, k: int = 5):
        if not 2 <= bins <= 256 or not 1 <= depth <= 8:
            raise ValueError("2 to 256 bins and 1 to 8 levels")
        self.fields, self.n_trees, self.depth, self.bins, self.lr, self.l2, self.min_rows, self.k = list(fields), trees, depth, bins, lr, l2, min_rows, k
        self.edges: list[list[float]] = []
        self.trees: list[Tree] = []

    def _binned(self, rows: DataFrame) -> Column:
        return F.array(*[F.coalesce(feature.bucket_left(F.col(f).cast("double"), e), F.lit(0)).cast("int") if e else F.lit(0) for f, e in zip(self.fields, self.edges, strict=True)])

    def _splits(self, table, nodes: int) -> tuple[dict[int, tuple[int, int]], np.ndarray]:
        """(best split of each node, its sums of g and h) from the histogram."""
        cells = np.zeros((3, nodes, len(self.fields), self.bins))
        for r in table:
            cells[:, r.node, r.feature, r.bin] = r.g, r.h, r.n
        left = np.cumsum(cells, axis=3)
        total = left[:, :, :, -1:]
        right = total - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sum(s[0] ** 2 / (s[1] + self.l2) for s in (left, right)) - total[0] ** 2 / (total[1] + self.l2)
        gain[(left[2] < self.min_rows) | (right[2] < self.min_rows)] = 0
        out = {}
        for n in range(nodes):
            f, b = np.unravel_index(int(gain[n].argmax()), gain[n].shape)
            if gain[n, f, b] > 1e-12:
                out[n] = int(f), int(b)
        return out, total[:2, :, 0, 0]

    def fit(self, train: DataFrame, row_id: str = "row_id") -> LambdaRank:
        self.edges = [sorted(set(feature.quantile_edges(train, f, self.bins))) for f in self.fields]
        rows = cut(train.select(row_id, "user_id", "label", self._binned(train).alias("bins"), F.lit(0.0).alias("score")))
        self.trees = []
        for _ in range(self.n_trees):
            own = cut(rows.join(lambdas(rows, self.k, row_id=row_id).withColumnRenamed(row_id, "_r"), F.col(row_id) == F.col("_r")).drop("_r"))
            tree, sums = Tree(), {}
            for level in range(self.depth + 1):
                nodes, first = 2**level, 2**level - 1
                here = own.select((tree.node(F.col("bins"), level) - first).cast("long").alias("node"), "bins", "g", "h").where((F.col("node") >= 0) & (F.col("node") < nodes))
                splits, total = self._splits(histogram(here, nodes, len(self.fields), self.bins).collect(), nodes)  # a bounded table
                sums |= {first + n: total[:, n] for n in range(nodes)}
                if level == self.depth or not splits:
                    break
                tree.splits |= {first + n: s for n, s in splits.items()}
            inner = set(tree.splits)
            ends = {0} if not inner else {c for n in inner for c in (2 * n + 1, 2 * n + 2)} - inner
            tree.leaves = {n: float(-sums[n][0] / (sums[n][1] + self.l2)) for n in sorted(ends) if n in sums and sums[n].any()}
            self.trees.append(tree)
            if not inner:
                break
            rows = cut(own.select(row_id, "user_id", "label", "bins", (F.col("score") + self.lr * tree.value(F.col("bins"), self.depth)).alias("score")))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with score; all trees are one expression over the bins of a row."""
        binned = rows.withColumn("_bins", self._binned(rows))
        values = [self.lr * t.value(F.col("_bins"), self.depth) for t in self.trees]
        return binned.withColumn("score", sum(values[1:], values[0]) if values else F.lit(0.0)).drop("_bins")


"""Deterministic samples and partitions: a row's fate depends on a hash of its key only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.operators.features import placed

#: Train fractions of the fidelity ladder.
FIDELITY = {"smoke": 0.02, "low": 0.15, "medium": 0.40, "high": 0.75, "full": 1.0}


def stratified(rows: DataFrame, fraction: float, order: Column | str, stratum: str = "label", buckets: int = 64) -> DataFrame:
    """Exactly max(1, round half even(n * fraction)) rows of each stratum, the first in ``order`` (numeric; ties by the other columns).

    No task sees a whole stratum: approximate quantiles cut the order into
    buckets, bucket counts tell how many rows each gives, and only the bucket
    that holds the last row is numbered.
    """
    key = F.col(order) if isinstance(order, str) else order
    keyed = rows.withColumn("_k", key)
    levels = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = keyed.groupBy(F.col(stratum).alias("_s")).agg(F.percentile_approx(F.col("_k").cast("double"), levels, F.lit(10_000)).alias("_e"), F.count(F.lit(1)).alias("_t"))
    placed = keyed.join(F.broadcast(edges), F.col(stratum).eqNullSafe(F.col("_s")))
    placed = placed.withColumn("_b", F.size(F.filter("_e", lambda e: e <= F.col("_k").cast("double")))).withColumn("_m", F.greatest(F.lit(1), F.bround(F.col("_t") * fraction)).cast("long")).drop("_e")
    sizes = placed.groupBy("_s", "_b", "_m").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = sizes.withColumn("_left", F.col("_m") - before).where("_left > 0").select(F.col("_s").alias("_s2"), F.col("_b").alias("_b2"), "_left", (F.col("_left") >= F.col("_n")).alias("_whole"))
    chosen = placed.join(F.broadcast(take), F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_b") == F.col("_b2")))
    part = chosen.where(~F.col("_whole")).withColumn("_p", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_k", *rows.columns))).where("_p <= _left")
    return chosen.where("_whole").select(rows.columns).unionByName(part.select(rows.columns))


def hash_order(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the md5 of seed and key: the same in every engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def whole_users(rows: DataFrame, max_rows: int, order: Column, user: str = "user_id") -> DataFrame:
    """Users taken whole in ``order`` (numeric) until max_rows is reached.  The running sum is over users, not rows."""
    counts = rows.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", order)
    return rows.join(placed(counts, "_o", [user], "_b", "_n").where(F.col("_b") < max_rows).select(user), user, "left_semi")


def in_holdout(user: Column, fraction: float) -> Column:
    """crc32 of the user's text modulo 10000 below round(fraction * 10000)."""
    return F.crc32(user.cast("string")) % 10_000 < round(fraction * 10_000)


def fold_of(row_id: Column, folds: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(folds))


def downsample_negatives(rows: DataFrame, keep: Column, floor: int, order: str = "row_id", user: str = "user_id") -> DataFrame:
    """All positives, the negatives that ``keep`` marks, and at least ``floor`` negatives per user (first in order)."""
    place = F.row_number().over(Window.partitionBy(user, "label").orderBy(order))
    return rows.withColumn("_p", place).where((F.col("label") == 1) | keep | (F.col("_p") <= floor)).drop("_p")

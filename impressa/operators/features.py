"""Train-only statistics and the feature operators built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.sources.shared import cut


def popularity(train: DataFrame, item: str = "item_id", prior: float = 20.0) -> DataFrame:
    """Per item: n, positives, smoothed rate (positives + prior * mean) / (n + prior); and the mean."""
    if not 1 <= prior <= 200:
        raise ValueError("prior must lie in 1..200")
    per, mean = _item_counts(train, item)
    return per.select(item, "n", "positives", ((F.col("positives") + prior * mean) / (F.col("n") + prior)).alias("rate"), mean.alias("mean"))


def _item_counts(train: DataFrame, item: str) -> tuple[DataFrame, Column]:
    """(a row per item, written once, so that train is read once; the mean label)"""
    per = cut(train.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positives"), F.count("label").alias("_l")))
    return per, F.lit(per.agg(F.sum("positives") / F.sum("_l")).first()[0]).cast("double")


def popularity_scores(rows: DataFrame, train: DataFrame, item: str = "item_id", prior: float = 20.0, exposures: str | None = None) -> DataFrame:
    """rows with score; an item that train lacks gets the train mean.  ``exposures`` names a column for the train count."""
    if not 1 <= prior <= 200:
        raise ValueError("prior must lie in 1..200")
    per, mean = _item_counts(train, item)
    known = per.select(F.col(item).alias("_i"), F.col("n").alias("_x"), "positives")
    out = rows.join(known, F.col(item) == F.col("_i"), "left").withColumn("score", F.coalesce((F.col("positives") + prior * mean) / (F.col("_x") + prior), mean))
    if exposures:
        out = out.withColumn(exposures, F.coalesce("_x", F.lit(0)).cast("long"))
    return out.drop("_i", "_x", "positives")


def placed(rows: DataFrame, key: str, ties: list[str], name: str, weight: str | None = None) -> DataFrame:
    """rows with ``name``, the sum of the weights (or number) of the rows before each in the order of key and ties; nulls come first.

    No task sees all rows: approximate quantiles of the numeric key cut the
    order in pieces, and a piece starts from the sum of those before.
    """
    pieces = min(256, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(rows.agg(F.percentile_approx(F.col(key).cast("double"), [i / pieces for i in range(1, pieces)], F.lit(10_000)).alias("e")).first().e or []))
    own = rows.withColumn("_piece", F.coalesce(bucket_left(F.col(key).cast("double"), cuts), F.lit(-1)))
    w = F.lit(1) if weight is None else F.col(weight)
    sums = own.groupBy("_piece").agg(F.sum(w).alias("_s"))
    before = sums.select(F.col("_piece").alias("_q"), F.coalesce(F.sum("_s").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per piece
    inside = F.coalesce(F.sum(w).over(Window.partitionBy("_piece").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("_inside", inside).join(F.broadcast(before), F.col("_piece") == F.col("_q")).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_piece", "_q", "_before", "_inside")


def quantile_edges(train: DataFrame, column: str, bins: int) -> list[float]:
    """Inner quantiles with linear interpolation (exact): the two rows around each are looked up in the running count of the values."""
    values = cut(train.where(F.col(column).isNotNull() & ~F.isnan(column)).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    total = values.agg(F.sum("n").alias("t")).first().t or 0
    if not total:
        return []
    spots = [i * (total - 1) / bins for i in range(1, bins)]
    wanted = sorted({x for s in spots for x in (int(s), min(int(s) + 1, total - 1))})
    at = placed(values, "v", [], "before", "n").withColumn("i", F.explode(F.filter(F.array(*[F.lit(x) for x in wanted]), lambda x: (x >= F.col("before")) & (x < F.col("before") + F.col("n")))))
    found = {r.i: r.v for r in at.select("i", "v").collect()}  # two rows per level at most
    return [found[int(s)] if s == int(s) else (int(s) + 1 - s) * found[int(s)] + (s - int(s)) * found[int(s) + 1] for s in spots]


def bucket_left(value: Column, edges: list[float]) -> Column:
    """Number of edges below the value; equality stays left."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < value)) if edges else F.lit(0)


def bucket_right(value: Column, edges: list[float]) -> Column:
    """1 + number of distinct edges up to the value; null is 0, the slot of unknown values."""
    own = sorted(set(edges))
    n = F.size(F.filter(F.array(*[F.lit(float(e)) for e in own]), lambda e: e <= value)) + 1 if own else F.lit(1)
    return F.when(value.isNull() | F.isnan(value), 0).otherwise(n)


def vocabulary(train: DataFrame, field: str, row_id: str = "row_id", first: int = 0) -> DataFrame:
    """(value, code): dense codes in order of first occurrence."""
    seen = cut(train.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.min(row_id).alias("at")))
    return placed(seen, "at", ["value"], "code").select("value", (F.col("code") + first).cast("int").alias("code"))


def auto_codes(rows: DataFrame, train: DataFrame, field: str, bins: int, row_id: str = "row_id") -> DataFrame:
    """rows with code: a float field of more than ``bins`` train values by its train quantiles (1 and up), others by vocabulary from 1; 0 is unknown or missing."""
    kind = train.schema[field].dataType.simpleString()
    values = train.where(F.col(field).isNotNull() & ~F.isnan(field)) if kind in ("float", "double") else train
    if kind in ("float", "double") and values.select(field).distinct().count() > bins:
        return rows.withColumn("code", bucket_right(F.col(field), quantile_edges(train, field, bins)).cast("int"))
    codes = vocabulary(values, field, row_id, 1).select(F.col("value").alias("_v"), F.col("code").alias("_c"))
    return rows.join(codes, F.col(field) == F.col("_v"), "left").withColumn("code", F.coalesce("_c", F.lit(0)).cast("int")).drop("_v", "_c")


def apply_target_encoding(rows: DataFrame, train: DataFrame, field: str, smoothing: float = 20.0) -> DataFrame:
    """rows with encoding, learnt on all of train; a value that train lacks gets the train mean.  Keys are compared as text."""
    table = target_encoding(train, field, smoothing).select(F.col("value").alias("_v"), F.col("encoding").alias("_e"))
    mean = train.agg(F.avg("label").alias("_g"))
    return rows.join(table, F.col(field).cast("string") == F.col("_v"), "left").crossJoin(F.broadcast(mean)).withColumn("encoding", F.coalesce("_e", "_g")).drop("_v", "_e", "_g")


def encode(rows: DataFrame, train: DataFrame, fields: list[str], row_id: str = "row_id") -> DataFrame:
    """Codes of each field; a value that train lacks gets the vocabulary's size."""
    for f in fields:
        v = cut(vocabulary(train, f, row_id)).select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        rows = rows.join(v, F.col(f) == F.col("_v"), "left").withColumn(f"{f}_code", F.coalesce("_c", F.lit(v.count())).cast("int")).drop("_v", "_c")
    return rows


def field_offsets(train: DataFrame, fields: list[str]) -> DataFrame:
    """(field, position, cardinality, first): where each field's codes begin, one slot each for unknown values."""
    dims = train.agg(*[(F.count_distinct(f) + 1).alias(f) for f in fields])
    long = dims.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("position"), F.col(f).alias("cardinality")) for i, f in enumerate(fields)])).alias("d")).select("d.*")
    return long.withColumn("first", F.coalesce(F.sum("cardinality").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def target_encoding(train: DataFrame, field: str, smoothing: float = 20.0) -> DataFrame:
    """(value, encoding): (sum + smoothing * mean) / (n + smoothing)."""
    per = train.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n"))
    mean = train.agg(F.avg("label").alias("g"))
    return per.crossJoin(F.broadcast(mean)).select("value", ((F.col("s") + smoothing * F.col("g")) / (F.col("n") + smoothing)).alias("encoding"))


def target_encoding_oof(train: DataFrame, field: str, fold: Column, smoothing: float = 20.0) -> DataFrame:
    """train with encoding from the other folds, by subtraction: no scan per fold.

    The prior is the mean of all of train.
    """
    cells = train.withColumn("_f", fold).groupBy(field, "_f").agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(field)
    cells = cells.select(F.col(field).alias("_v"), F.col("_f").alias("_g"), (F.sum("s").over(w) - F.col("s")).alias("s"), (F.sum("n").over(w) - F.col("n")).alias("n"))
    mean = train.agg(F.avg("label").alias("g"))
    rows = train.withColumn("_f", fold).join(cells, F.col(field).eqNullSafe(F.col("_v")) & (F.col("_f") == F.col("_g"))).crossJoin(F.broadcast(mean))
    encoding = F.coalesce(F.try_divide(F.col("s") + smoothing * F.col("g"), F.col("n") + smoothing), F.col("g"))
    return rows.withColumn("encoding", encoding).drop("_f", "_v", "_g", "s", "n", "g")


def frequency(rows: DataFrame, train: DataFrame, field: str) -> DataFrame:
    """rows with n, the train count of the value (0 if absent)."""
    n = train.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(n, F.col(field) == F.col("_v"), "left").withColumn("n", F.coalesce("_n", F.lit(0)).cast("long")).drop("_v", "_n")


def frequency_bucket(n: Column, edges: list[int], equal_up: bool = True) -> Column:
    """Bucket of a count: an equal edge counts as passed (equal_up) or not."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: (e <= n) if equal_up else (e < n)))


def category_fallback(rows: DataFrame, train: DataFrame, item: str, category: str, k: int) -> DataFrame:
    """Blend (1 - b) n + b cat with b = 1 - min(1, n / k).

    cat is the mean item count over the train rows of frequent items (n >= k) of
    the category, over all rows if no item is frequent; absent categories get 0.
    """
    # one pass over train: rows per category and item, then items
    cells = train.groupBy(F.col(category).alias("_c"), F.col(item).alias("_i")).agg(F.count(F.lit(1)).alias("_r"))
    counts = cells.groupBy(F.col("_i").alias("_j")).agg(F.sum("_r").alias("_n"))
    counted = cells.join(counts, F.col("_i").eqNullSafe(F.col("_j")))
    some = counts.agg(F.max("_n").alias("_m"))
    base = counted.crossJoin(F.broadcast(some)).where((F.col("_n") >= k) | (F.col("_m") < k))
    cat = base.groupBy("_c").agg((F.sum(F.col("_n") * F.col("_r")) / F.sum("_r")).alias("_mean"))
    out = frequency(rows, train, item).join(cat, F.col(category) == F.col("_c"), "left")
    b = 1 - F.least(F.lit(1.0), F.col("n") / k)
    return out.withColumn("blend", (1 - b) * F.col("n") + b * F.coalesce("_mean", F.lit(0.0))).drop("_c", "_mean")


def history(rows: DataFrame, keys: list[str], day: str, prior: float = 20.0) -> DataFrame:
    """Impressions and smoothed rate of the same keys on strictly earlier days."""
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    n, s = F.count(F.lit(1)).over(w), F.coalesce(F.sum("label").over(w), F.lit(0))
    return rows.withColumn("hist_n", n).withColumn("hist_pos", s.cast("long")).withColumn("hist_rate", (F.col("hist_pos") + prior * 0.5) / (F.col("hist_n") + prior))


def recent_items(rows: DataFrame, user: str, day: str, item: str, row_id: str, length: int) -> DataFrame:
    """The last items of a user on strictly earlier days.

    Each of a user's days keeps its last ``length`` rows; a row then looks at
    ``length`` days before its own, so no array grows with the history.
    """
    late = F.row_number().over(Window.partitionBy(user, day).orderBy(F.desc(row_id), F.desc(item)))
    days = rows.select(user, day, row_id, item).withColumn("_p", late).where(F.col("_p") <= length)
    days = days.groupBy(F.col(user).alias("_u"), F.col(day).alias("_d")).agg(F.array_sort(F.collect_list(F.struct(row_id, item))).alias("_i"))
    w = Window.partitionBy("_u").orderBy("_d").rowsBetween(-length, -1)
    seen = F.flatten(F.collect_list(F.transform("_i", lambda x: x[item])).over(w))
    last = F.slice(seen, F.greatest(F.size(seen) - length + 1, F.lit(1)), length)
    days = days.select("_u", "_d", last.alias("recent"))
    return rows.join(days, F.col(user).eqNullSafe(F.col("_u")) & F.col(day).eqNullSafe(F.col("_d"))).drop("_u", "_d")


def decay_weights(rows: DataFrame, day: Column, decay: float) -> DataFrame:
    """weight = decay ** (days before the last day)."""
    last = rows.agg(F.max(day).alias("_last"))
    return rows.crossJoin(F.broadcast(last)).withColumn("weight", F.pow(F.lit(decay), F.datediff("_last", day))).drop("_last")


def positive_negative_pairs(rows: DataFrame, user: str = "user_id", row_id: str = "row_id") -> DataFrame:
    """(user, positive, negative) row pairs of each user."""
    a = rows.where("label = 1").select(user, F.col(row_id).alias("positive"))
    return a.join(rows.where("label = 0").select(user, F.col(row_id).alias("negative")), user)


def rank_fusion(parts: list[tuple[DataFrame, float]], user: str = "user_id", row_id: str = "row_id") -> DataFrame:
    """Weighted sum of the within-user percent ranks of several score tables."""
    ranked = [p.select(user, row_id, (w * F.percent_rank().over(Window.partitionBy(user).orderBy("score"))).alias("r")) for p, w in parts]
    total = ranked[0]
    for r in ranked[1:]:
        total = total.unionByName(r)
    return total.groupBy(user, row_id).agg(F.sum("r").alias("score"))


def column_rank_fusion(rows: DataFrame, weights: dict[str, float], user: str = "user_id", row_id: str = "row_id") -> DataFrame:
    """Weighted sum of the within-user percent ranks of several columns of one table, in one pass."""
    ranks = [w * F.percent_rank().over(Window.partitionBy(user).orderBy(c)) for c, w in weights.items()]
    return rows.select(user, row_id, sum(ranks[1:], ranks[0]).alias("score"))

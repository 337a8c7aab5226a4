"""Within-user ranking metrics: tie-aware AUC, GAUC, nDCG@k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def user_metrics(df: DataFrame, groups: list[str] | None = None, k: int = 5) -> DataFrame:
    """Per (groups, user_id): n, positives, auc (null unless both labels occur), dcg, idcg, ndcg.

    df has user_id, label, score and row_id.  Equal scores share their mean rank
    in AUC; in nDCG they keep row_id order.
    """
    key = [*(groups or []), "user_id"]
    w = Window.partitionBy(*key)
    rank = F.rank().over(w.orderBy("score")) + (F.count(F.lit(1)).over(Window.partitionBy(*key, "score")) - 1) / 2
    ranked = df.select(*key, "label", rank.alias("r"), F.row_number().over(w.orderBy(F.desc("score"), "row_id")).alias("pos"), F.row_number().over(w.orderBy(F.desc("label"), "row_id")).alias("best"))
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    out = ranked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positives"), F.sum(F.when(F.col("label") == 1, F.col("r"))).alias("ranks"),
        F.coalesce(F.sum(F.when(F.col("pos") <= k, gain / F.log2(F.col("pos") + 1.0))), F.lit(0.0)).alias("dcg"), F.coalesce(F.sum(F.when(F.col("best") <= k, gain / F.log2(F.col("best") + 1.0))), F.lit(0.0)).alias("idcg"))
    p, n = F.col("positives"), F.col("n")
    auc = F.when((p > 0) & (p < n), (F.col("ranks") - p * (p + 1) / 2) / (p * (n - p)))
    return out.withColumn("auc", auc).withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)).drop("ranks")


def ranking_metrics(df: DataFrame, groups: list[str] | None = None, k: int = 5) -> DataFrame:
    """Per group (or one row): gauc, ndcg, primary, rows, positives, users.

    GAUC weights the users who have both labels by their positives; 0.5 if there
    are none.
    """
    u = user_metrics(df, groups, k)
    gauc = F.coalesce(F.try_divide(F.sum(F.col("auc") * F.col("positives")), F.sum(F.when(F.col("auc").isNotNull(), F.col("positives")))), F.lit(0.5))
    aggs = [gauc.alias("gauc"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.sum("positives"), F.lit(0)).cast("long").alias("positives"), F.count(F.lit(1)).alias("users")]
    out = u.groupBy(*groups).agg(*aggs) if groups else u.agg(*aggs)
    return out.withColumn("primary_score", (F.col("gauc") + F.col("ndcg")) / 2)


def logloss(df: DataFrame, eps: float = 1e-7) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("score")))
    return df.agg(F.avg(-(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))).alias("logloss"))


def label_composition(df: DataFrame) -> DataFrame:
    """One row: users, users with both labels, and shares without and with only positives."""
    u = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    mixed, none, every = (F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("p") == 0, F.col("p") == F.col("n")
    out = u.agg(F.count(F.lit(1)).alias("users"), F.count_if(mixed).alias("gauc_users"), F.count_if(none).alias("none"), F.count_if(every).alias("every"))
    return out.select("users", "gauc_users", (F.col("gauc_users") / F.col("users")).alias("gauc_share"), (F.col("none") / F.col("users")).alias("zero_pos_share"), (F.col("every") / F.col("users")).alias("all_pos_share"))


#: Exposure buckets: smallest train count of each, and their names.
EXPOSURE_EDGES = (0, 10, 100, 1000)
EXPOSURE_NAMES = ("0-9", "10-99", "100-999", "1000+")
MIN_GROUP_ROWS = 200


def exposure_bucket(n):
    return F.coalesce(*[F.when(n >= e, name) for e, name in reversed(list(zip(EXPOSURE_EDGES, EXPOSURE_NAMES, strict=True)))])


def scorecard(scored: DataFrame, train: DataFrame, k: int = 5, min_rows: int = MIN_GROUP_ROWS) -> DataFrame:
    """All group metrics in one pass: by exposure bucket, seen user, date, and in total.

    scored has row_id, user_id, item_id, date, label, score, and exposures if it
    was counted with the scores.  Each row is dealt
    once per grouping; users are ranked within a group's own rows.  Groups under
    min_rows or with one label have no metrics.
    """
    if "exposures" not in scored.columns:
        counts = train.groupBy(F.col("item_id").alias("_i")).agg(F.count(F.lit(1)).alias("exposures"))
        scored = scored.join(counts, F.col("item_id") == F.col("_i"), "left")
    users = train.select(F.col("user_id").alias("_u")).distinct().withColumn("_seen", F.lit(True))
    rows = scored.join(users, F.col("user_id") == F.col("_u"), "left")
    bucket = exposure_bucket(F.coalesce("exposures", F.lit(0)))
    seen = F.when(F.col("_seen"), "seen").otherwise("unseen")
    kinds = F.array(*[F.struct(F.lit(a).alias("dim"), b.cast("string").alias("grp")) for a, b in (("exposure", bucket), ("seen", seen), ("date", F.col("date")), ("all", F.lit("all")))])
    rows = rows.select("row_id", "user_id", "label", "score", F.explode(kinds).alias("g")).select("row_id", "user_id", "label", "score", "g.dim", "g.grp")
    m = ranking_metrics(rows, ["dim", "grp"], k)
    enough = (F.col("n_rows") >= min_rows) & (F.col("positives") > 0) & (F.col("positives") < F.col("n_rows"))
    share = F.col("n_rows") / F.max(F.when(F.col("dim") == "all", F.col("n_rows"))).over(Window.partitionBy())  # a row per group
    m = m.withColumn("share", share).select("dim", "grp", "n_rows", "positives", "users", "share", *[F.when(enough, F.col(c)).alias(c) for c in ("gauc", "ndcg", "primary_score")])
    fixed = m.sparkSession.createDataFrame([*[("exposure", n) for n in EXPOSURE_NAMES], ("seen", "seen"), ("seen", "unseen")], "dim string, grp string")
    empty = fixed.join(m, ["dim", "grp"], "left_anti")
    return m.unionByName(empty, allowMissingColumns=True).fillna(0, ["n_rows", "positives", "users", "share"])

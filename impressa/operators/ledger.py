"""Analytics of an experiment session's ledgers: cards, trust, noise, convergence, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOISE_FLOOR = 0.0005


def card_match(cards: DataFrame, findings: DataFrame, limit: int = 5, exclude: DataFrame | None = None) -> DataFrame:
    """Cards (id, treats, prior, ord) by summed severity of the findings (symptom, severity) they treat, then prior, then ord; none of ``exclude`` (id)."""
    if exclude is not None:
        cards = cards.join(exclude.select("id"), "id", "left_anti")
    hit = cards.select("id", "prior", "ord", F.explode("treats").alias("symptom")).join(findings, "symptom")
    out = hit.groupBy("id", "prior", "ord").agg(F.sum(F.coalesce("severity", F.lit(1.0))).alias("severity"))
    return out.orderBy(F.desc("severity"), F.desc("prior"), "ord").limit(limit).select("id", "severity", "prior")


def uncovered(symptoms: DataFrame, cards: DataFrame) -> DataFrame:
    """Treatable symptoms that no card treats."""
    return symptoms.where("treatable").join(cards.select(F.explode("treats").alias("id")), "id", "left_anti").select("id")


def schedule(proposals: DataFrame) -> DataFrame:
    """Proposals (id, gain, prior, difficulty, multiplier) by positive gain * prior / (difficulty * max(0.1, multiplier)); rank 1 is chosen."""
    score = F.greatest(F.col("gain"), F.lit(0.0)) * F.col("prior") / (F.col("difficulty") * F.greatest(F.lit(0.1), F.col("multiplier")))
    out = proposals.select("id", score.alias("score"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def trust(updates: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Per card the prior after its updates (card, seq, delta, prior) in order, clamped at each step."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"])
    return updates.groupBy("card").agg(F.min("prior").alias("prior"), steps.alias("steps")).select("card", F.aggregate("steps", F.col("prior"), lambda p, d: F.greatest(F.lit(low), F.least(F.lit(high), p + d))).alias("prior"))


def time_multiplier(runs: DataFrame) -> DataFrame:
    """Per card: median seconds over the median of all runs."""
    total = runs.agg(F.median("seconds").alias("_all"))
    return runs.groupBy("card").agg(F.median("seconds").alias("m")).crossJoin(F.broadcast(total)).select("card", (F.col("m") / F.col("_all")).alias("multiplier"))


def noise_bands(runs: DataFrame, least: int = 3) -> DataFrame:
    """Per metric of repeated runs (metric, value): mean, sd, range, band = 2 sqrt(2) sd; fewer than ``least`` runs give none."""
    out = runs.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.max("value") - F.min("value")).alias("spread"), F.count("value").alias("n")).where(F.col("n") >= least)
    return out.withColumn("band", 2 * F.sqrt(F.lit(2.0)) * F.col("sd"))


def beats_noise(gains: DataFrame, bands: DataFrame) -> DataFrame:
    """Per run: does any metric's gain pass its band, or the floor?"""
    b = bands.select(F.col("metric").alias("_m"), "band")
    hit = F.abs("gain") >= F.greatest(F.lit(NOISE_FLOOR), F.coalesce("band", F.lit(0.0)))
    return gains.join(b, F.col("metric") == F.col("_m"), "left").groupBy("run").agg(F.bool_or(hit).alias("beats"))


def convergence(rounds: DataFrame, epsilon: float, patience: int, margin: float) -> DataFrame:
    """Per session, folding rounds (session, round, score) in order: best score and round, stale rounds, stop and rollback.

    The best moves only when beaten by more than epsilon, so the fold is ordered.
    """
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(-1).alias("best_round"), F.lit(0).alias("stale"), F.lit(float("-inf")).alias("last"))

    def step(s, r):
        better = r["score"] > s["best"] + epsilon
        return F.struct(F.when(better, r["score"]).otherwise(s["best"]).alias("best"), F.when(better, r["round"]).otherwise(s["best_round"]).alias("best_round"), F.when(better, 0).otherwise(s["stale"] + 1).alias("stale"), r["score"].alias("last"))

    folded = rounds.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("round", "score"))).alias("r")).select("session", F.aggregate("r", start, step).alias("s"))
    return folded.select("session", "s.best", "s.best_round", "s.stale", (F.col("s.stale") >= patience).alias("stop"), (F.col("s.last") < F.col("s.best") - margin).alias("rollback"))


def early_stopping(epochs: DataFrame, patience: int, min_delta: float, maximise: bool = True) -> DataFrame:
    """Per run, over epochs (run, epoch, value): best epoch and the epoch to stop at, null if never."""
    sign = 1.0 if maximise else -1.0
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(-1).alias("at"), F.lit(0).alias("bad"), F.lit(-1).alias("stop"))

    def step(s, r):
        v = r["value"] * sign
        better = v > s["best"] + min_delta
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        done = s["stop"] >= 0
        new = F.struct(F.when(better, v).otherwise(s["best"]).alias("best"), F.when(better, r["epoch"]).otherwise(s["at"]).alias("at"), bad.alias("bad"), F.when(bad >= patience, r["epoch"]).otherwise(-1).alias("stop"))
        return F.when(done, s).otherwise(new)

    folded = epochs.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "value"))).alias("e")).select("run", F.aggregate("e", start, step).alias("s"))
    return folded.select("run", F.col("s.at").alias("best_epoch"), F.when(F.col("s.stop") >= 0, F.col("s.stop")).alias("stop_epoch"))


def swa(weights: DataFrame, total_epochs: int, ratio: float) -> DataFrame:
    """Mean of each parameter over the epochs from int(total * ratio); epochs count from 1."""
    return weights.where(F.col("epoch") >= int(total_epochs * ratio)).groupBy("parameter").agg(F.avg("value").alias("value"))


def shelf(entries: DataFrame, keep: int = 5) -> DataFrame:
    """The newest entry per (card, targets), then the ``keep`` newest of all."""
    newest = entries.withColumn("_r", F.row_number().over(Window.partitionBy("card", "targets").orderBy(F.desc("round")))).where("_r = 1").drop("_r")
    return newest.orderBy(F.desc("round"), "card").limit(keep)


def effect_verdict(rounds: DataFrame) -> DataFrame:
    """Did a round change its scores?  Its digest against that of the last successful round before."""
    w = Window.partitionBy("session").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("ok"), F.col("digest")), ignorenulls=True).over(w)
    verdict = F.when(~F.col("ok"), "failed").when(before.isNull(), "first").when(before == F.col("digest"), "no effect").otherwise("changed")
    return rounds.select("session", "round", verdict.alias("verdict"))


def score_digest(scores: DataFrame) -> DataFrame:
    """Order-free digest of a score table: xor of row hashes and their count."""
    return scores.agg(F.bit_xor(F.xxhash64("row_id", "score")).alias("digest"), F.count(F.lit(1)).alias("n"))


def streaks(rounds: DataFrame) -> DataFrame:
    """Length of the run of failures that ends at each round (gaps and islands)."""
    w = Window.partitionBy("session").orderBy("round")
    island = rounds.withColumn("g", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(w))
    fails = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("session", "g").orderBy("round"))
    return island.select("session", "round", fails.cast("long").alias("failures"))


def holdout_luck(rounds: DataFrame) -> DataFrame:
    """Per metric, first to best round (metric, part, round, value): gains on both parts and their difference."""
    g = rounds.groupBy("metric", "part").agg((F.max_by("value", "round") - F.min_by("value", "round")).alias("gain"))
    out = g.groupBy("metric").pivot("part", ["dev", "holdout"]).agg(F.first("gain"))
    return out.select("metric", F.col("dev").alias("dev_gain"), F.col("holdout").alias("holdout_gain"), (F.col("dev") - F.col("holdout")).alias("luck"))


def token_totals(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by role, by model and in total, in one pass (grouping sets)."""
    usage.join(F.broadcast(prices), "model", "left").createOrReplaceTempView("_impressa_usage")
    return usage.sparkSession.sql("""
        select role, model, sum(tokens_in) as tokens_in, sum(tokens_out) as tokens_out, sum((tokens_in * price_in + tokens_out * price_out) / 1e6) as cost
        from _impressa_usage group by grouping sets ((role), (model), ())""")


def patch_merge(patches: DataFrame) -> DataFrame:
    """(path, value): the last write of each flattened path over the successful rounds (path, value, seq, ok)."""
    return patches.where("ok").groupBy("path").agg(F.max_by("value", "seq").alias("value"))


def budget_tier(used, total):
    """0 below 60 % of the budget, 1 from there, 2 from 85 %."""
    share = used / total
    return F.when(share >= 0.85, 2).when(share >= 0.6, 1).otherwise(0)


def monotone_fall(groups: DataFrame) -> DataFrame:
    """Per run: does the score fall at every date?"""
    d = F.lag("score").over(Window.partitionBy("run").orderBy("date")) > F.col("score")
    return groups.select("run", d.alias("d")).groupBy("run").agg((F.every(F.coalesce("d", F.lit(True))) & (F.count(F.lit(1)) > 1)).alias("falls"))

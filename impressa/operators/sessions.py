"""Rules and accounts of experiment sessions over ledgers of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.operators import ledger

#: Effort of a change by its stated difficulty: fixed values.
DIFFICULTY = {"config": 0.5, "easy": 1.0, "medium": 2.0, "hard": 3.0}
#: Words that a rationale must not hold: fixed values.
HEDGES = ("试试看", "可能有帮助", "值得一试", "一般来说效果不错", "应该有帮助")


def _broken(rules: list[tuple[str, Column]], name: str) -> Column:
    """One row per rule that holds; a condition that is null does not."""
    return F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())).alias(name)


#: Losses that score row by row, and features that hold more of a user's past than counts.
POINTWISE = ("bce", "logloss", "mse")
HISTORY = ("recent_items", "history_rate")


def symptom_rules(cards: DataFrame, low_train: float = 0.6) -> DataFrame:
    """(run, symptom) of scorecards.

    Columns: run, train_primary, valid_primary, low_gauc and low_share of the least exposed items (gauc null if too few rows),
    high_gauc, gauc, ndcg, prev_gauc, prev_ndcg (null in a first round), seen_gauc, unseen_gauc, falls, mixed_share,
    best_epoch, epochs, seconds, budget, sd (null with one seed), rows_match, nonfinite, distinct_scores; where there are any,
    low_band and primary_band (measured noise of the least exposed items' gauc and of the main score; null: not measured), loss and features.
    """
    has = set(cards.columns)
    c = F.col
    gap, up, top = c("train_primary") - c("valid_primary"), c("gauc") - c("prev_gauc"), c("ndcg") - c("prev_ndcg")
    low = F.coalesce("low_band", F.lit(0.03)) if "low_band" in has else F.lit(0.03)
    wide = gap > (F.coalesce("primary_band", F.lit(0.04)) if "primary_band" in has else F.lit(0.04))
    rules = [
        ("cold_items", (c("high_gauc") - c("low_gauc") > low) & (c("low_share") > 0.2)), ("opposite_moves", ((up > 0) & (top <= 0)) | ((top > 0) & (up <= 0))), ("memorising", wide),
        ("cold_users", c("seen_gauc") - c("unseen_gauc") >= 0.03), ("drift", c("falls") | (wide & (c("train_primary") < low_train))), ("degenerate_users", c("mixed_share") < 0.6), ("underfit", (gap < 0.02) & (c("best_epoch") == c("epochs"))),
        ("slow", c("seconds") / c("budget") > 0.05), ("unstable", c("sd") > 0.002), ("mismatch", ~c("rows_match") | (c("nonfinite") > 0) | (c("distinct_scores") <= 1))]
    if "loss" in has:
        rules.append(("pointwise_loss", c("loss").isin(*POINTWISE)))
    if "features" in has:
        rules.append(("unused_history", ~F.arrays_overlap("features", F.array(*map(F.lit, HISTORY)))))
    return cards.select("run", _broken(rules, "symptom"))


def danger_gate(cards: DataFrame, findings: DataFrame, gap: float = 0.15, severity: float = 0.7) -> DataFrame:
    """Runs whose train and valid scores lie more than ``gap`` apart and whose findings (run, symptom, severity) do not say so.

    What says so is a finding of memorising or of mismatched data, the severest of which is of ``severity`` or more.
    """
    danger = cards.where(F.abs(F.col("train_primary") - F.col("valid_primary")) > gap)
    said = findings.where(F.col("symptom").isin("memorising", "mismatch")).groupBy("run").agg(F.max("severity").alias("most")).where(F.col("most") >= severity)
    return danger.join(said, "run", "left_anti").select("run")


def reflection_violations(reflections: DataFrame, targets: DataFrame, items: DataFrame, floor: float = ledger.NOISE_FLOOR) -> DataFrame:
    """(id, rule) for each rule that a reflection breaks.

    reflections: id, effect, verdict (hit, miss, unclear or crashed), prior_delta, gain_a, gain_b, band_a, band_b (null: floor), promote.
    targets: id, symptom.  items: id, symptom, before, after, resolved (yes, partly or no).
    """
    same = F.col("resolved").isin("yes", "partly") & (F.abs(F.col("after") - F.col("before")) < 1e-9)
    told = items.groupBy("id").agg(F.count(F.lit(1)).alias("told"), F.bool_or(same).alias("same"), F.every(F.col("resolved") == "no").alias("none"))
    missing = targets.join(items.select("id", "symptom"), ["id", "symptom"], "left_anti").select("id").distinct().withColumn("missing", F.lit(True))
    rows = reflections.join(told, "id", "left").join(missing, "id", "left")
    hit, delta = F.col("verdict") == "hit", F.col("prior_delta")
    beats = (F.abs("gain_a") >= F.greatest(F.lit(floor), F.coalesce("band_a", F.lit(floor)))) | (F.abs("gain_b") >= F.greatest(F.lit(floor), F.coalesce("band_b", F.lit(floor))))
    rules = [
        ("no_effect_hit", ~F.col("effect") & hit), ("no_effect_penalty", ~F.col("effect") & (delta < 0)), ("too_many_resolved", F.col("told") > 3), ("prior_step", F.abs(delta) > 0.2), ("within_noise", hit & ~beats),
        ("target_missing", F.coalesce("missing", F.lit(False))), ("resolved_unchanged", F.coalesce("same", F.lit(False))), ("hit_unresolved", hit & F.coalesce("none", F.lit(True))), ("hit_without_gain", hit & (F.greatest("gain_a", "gain_b") <= 0)),
        ("miss_rewarded", (F.col("verdict") == "miss") & (delta > 0)), ("unclear_step", (F.col("verdict") == "unclear") & (F.abs(delta) > 0.05)), ("promote_without_hit", F.col("promote") & ~hit)]
    return rows.select("id", _broken(rules, "rule"))


def proposal_violations(proposals: DataFrame, candidates: DataFrame, top: DataFrame, cap: float = 0.05, least: float = 0.1, most: int = 3) -> DataFrame:
    """(session, id, rule); id is null for rules of a whole session.

    proposals: session, id, place, expected_a, expected_b, multiplier, rationale, how_to, card, novel, target.
    candidates: card, how_to.  top: session, symptom (the worst finding).
    """
    own = candidates.select(F.col("card").alias("_card"), F.col("how_to").alias("_how"))
    rows = proposals.join(own, F.col("card") == F.col("_card"), "left")
    begin = F.substring(F.trim("how_to"), 1, 40)
    hedge = F.greatest(*[F.col("rationale").contains(w).cast("int") for w in HEDGES]) == 1
    rules = [
        ("place", ~F.col("place").between(1, most)), ("expected", F.greatest(F.abs("expected_a"), F.abs("expected_b")) > cap), ("multiplier", F.col("multiplier") < least), ("hedge", hedge), ("no_number", ~F.col("rationale").rlike("[0-9]")),
        ("no_how_to", F.trim("how_to") == ""), ("copied_how_to", (F.col("_how") != "") & F.col("_how").contains(begin)), ("unknown_card", ~F.col("novel") & F.col("_card").isNull())]
    each = rows.select("session", "id", _broken(rules, "rule"))
    whole = proposals.join(top.select("session", F.col("symptom").alias("_top")), "session", "left").groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("target") == F.col("_top")).alias("hit"), F.max("_top").alias("_top"))
    session = whole.select("session", F.lit(None).cast("long").alias("id"), _broken([("too_many", F.col("n") > most), ("top_untargeted", F.col("_top").isNotNull() & ~F.coalesce("hit", F.lit(False)))], "rule"))
    return each.unionByName(session)


def trust_from_verdicts(rounds: DataFrame) -> DataFrame:
    """Per card the prior after its rounds (card, seq, verdict, beats, improved, prior) in order."""
    v = F.col("verdict")
    delta = F.when((v == "hit") & F.col("beats"), 0.15).otherwise(0.0) + F.when(F.col("improved"), 0.05).otherwise(0.0) + F.when(v == "miss", -0.10).when(v == "crashed", -0.15).otherwise(0.0)
    return ledger.trust(rounds.where("card is not null").select("card", "seq", delta.alias("delta"), "prior"))


def schedule(proposals: DataFrame, cards: DataFrame, measured: DataFrame, tried: DataFrame, tight: DataFrame) -> DataFrame:
    """(session, id, score, place): place 1 is chosen, the others are its backups.

    proposals: session, id, card (null: own idea), expected (map of gains), multiplier, difficulty.  cards: card, prior.
    measured: card, multiplier.  tried: session, card.  tight: sessions short of budget.
    Tried cards go unless all would; sessions short of budget take easy changes if there are any.
    """
    effort = F.coalesce(*[F.when(F.col("difficulty") == k, F.lit(v)) for k, v in DIFFICULTY.items()], F.lit(2.0))
    rows = proposals.join(cards.select("card", "prior"), "card", "left").join(measured.select("card", F.col("multiplier").alias("_m")), "card", "left")
    gain = F.aggregate(F.map_values("expected"), F.lit(0.0), lambda t, x: t + F.greatest(F.lit(0.0), x))
    rows = rows.withColumn("score", gain * F.coalesce("prior", F.lit(0.5)) / (effort * F.greatest(F.lit(0.1), F.coalesce("_m", "multiplier"))))
    rows = rows.join(tried.select("session", "card").distinct().withColumn("_tried", F.lit(True)), ["session", "card"], "left").join(tight.select("session").distinct().withColumn("_tight", F.lit(True)), "session", "left")
    w = Window.partitionBy("session")
    fresh = F.col("_tried").isNull()
    rows = rows.withColumn("_alive", fresh | ~F.bool_or(fresh).over(w)).where("_alive")
    easy = F.col("difficulty").isin("config", "easy")
    rows = rows.withColumn("_open", F.col("_tight").isNull() | easy | ~F.bool_or(easy).over(w)).where("_open")
    return rows.select("session", "id", "score", F.row_number().over(w.orderBy(F.desc("score"), "id")).alias("place"))


def session_totals(rounds: DataFrame) -> DataFrame:
    """Per session: rounds, hits, tokens, minutes, training minutes, interventions, recoveries, scored rounds."""
    return rounds.groupBy("session").agg(
        F.count(F.lit(1)).alias("rounds"), F.count_if(F.col("verdict") == "hit").alias("hits"), F.sum("tokens").alias("tokens"), (F.sum("seconds") / 60).alias("minutes"), (F.sum("train_seconds") / 60).alias("train_minutes"),
        F.sum("interventions").alias("interventions"), F.sum("recoveries").alias("recoveries"), F.count_if(F.col("score").isNotNull()).alias("scored"))


def step_costs(steps: DataFrame) -> DataFrame:
    """Per role of the steps (role, seconds, tokens): calls, seconds, tokens."""
    return steps.groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum("seconds").alias("seconds"), F.sum("tokens").alias("tokens"))


def card_memory(rounds: DataFrame) -> DataFrame:
    """(session, card, state): failed and crashed cards are blocked, hits are applied, each once; what is unclear may be tried again."""
    state = F.when(F.col("verdict").isin("miss", "crashed"), "blocked").when(F.col("verdict") == "hit", "applied")
    return rounds.where("card is not null").select("session", "card", state.alias("state")).where("state is not null").distinct()


def excluded(memory: DataFrame) -> DataFrame:
    """(session, card): blocked or applied, once."""
    return memory.select("session", "card").distinct()


def scores_of(reports: DataFrame) -> DataFrame:
    """(run, total): the stated primary score, else the sum of the two metrics, else minus infinity."""
    pair = F.when(F.col("gauc").isNotNull(), F.col("gauc") + F.coalesce("ndcg", F.lit(0.0)))
    return reports.select("run", F.coalesce("primary_score", pair, F.lit(float("-inf"))).alias("total"))


def envelope_errors(reports: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Runs whose primary score is not the mean of its metrics."""
    return reports.where(F.abs(F.col("primary_score") - (F.col("gauc") + F.col("ndcg")) / 2) > tolerance).select("run")


def metric_deltas(best: DataFrame, baseline: DataFrame, holdout: DataFrame, tolerance: float) -> DataFrame:
    """(session, metric, delta, gap, reproduced) from tables of (session, metric, value): against the baseline, against the holdout, and whether the baseline is met."""
    rows = best.join(baseline.select("metric", F.col("value").alias("_b")), "metric", "left").join(holdout.select("session", "metric", F.col("value").alias("_h")), ["session", "metric"], "left")
    delta = F.col("value") - F.col("_b")
    return rows.select("session", "metric", delta.alias("delta"), (F.col("value") - F.col("_h")).alias("gap"), (F.abs(delta) <= tolerance).alias("reproduced"))


def usable_bands(bands: DataFrame, rounds: DataFrame) -> DataFrame:
    """(session, round, metric, band): a band counts only for rounds at the fidelity it was measured at."""
    return rounds.join(bands, "fidelity").select("session", "round", "metric", "band")


def crashed_reflections(rounds: DataFrame, targets: DataFrame) -> DataFrame:
    """(session, round, symptom, resolved, prior_delta) written for rounds that crashed: no target is resolved."""
    return rounds.where("not ok").join(targets, ["session", "round"]).select("session", "round", "symptom", F.lit("no").alias("resolved"), F.lit(-0.15).alias("prior_delta"))


def stage_of(rounds: DataFrame) -> DataFrame:
    """(session, round, stage): the first of four stages that is not done, null if all are."""
    stages = [("diagnosis", F.col("findings") > 0), ("proposal", F.col("proposals") > 0), ("patch", F.col("patched")), ("reflection", F.col("reflected"))]
    return rounds.select("session", "round", F.coalesce(*[F.when(~F.coalesce(done, F.lit(False)), F.lit(name)) for name, done in stages]).alias("stage"))


def budget_left(attempts: DataFrame, max_attempts: int, max_seconds: float) -> DataFrame:
    """(session, seq, attempts_left, seconds_left, tier) after each attempt; tier 2 from 85 % of the time, 1 from 60 %."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum("seconds").over(w)
    return attempts.select("session", "seq", F.greatest(F.lit(0), F.lit(max_attempts) - F.count(F.lit(1)).over(w)).cast("long").alias("attempts_left"), F.greatest(F.lit(0.0), F.lit(max_seconds) - used).alias("seconds_left"), ledger.budget_tier(used, F.lit(max_seconds)).alias("tier"))


def restore_snapshots(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(session, round, path, content) of the snapshots (session, round, path, owner) of which every file is found in its owner's round of the same session."""
    own = files.select("session", F.col("round").alias("owner"), "path", "content")
    rows = snapshots.join(own, ["session", "owner", "path"], "left")
    whole = F.every(F.col("content").isNotNull()).over(Window.partitionBy("session", "round"))
    return rows.withColumn("_whole", whole).where("_whole").select("session", "round", "path", "content")


def best_rounds(rounds: DataFrame) -> DataFrame:
    """(session, round, score): the best successful round, the first of equals; sessions without one are left out."""
    return rounds.where("ok and score is not null").groupBy("session").agg(F.max_by(F.struct("round", "score"), F.struct("score", -F.col("round"))).alias("b")).select("session", "b.round", "b.score")


def unknown_tags(cards: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, tag): tags that the vocabulary lacks."""
    return cards.select("id", F.explode("tags").alias("tag")).join(vocabulary.select("tag"), "tag", "left_anti").select("id", "tag")


def without_keys(reports: DataFrame, column: str, marks: list[str]) -> DataFrame:
    """reports without the map entries whose key holds one of the marks."""
    return reports.withColumn(column, F.map_filter(column, lambda k, v: ~_any_in(k, marks)))


def _any_in(text: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def example_for(stage: Column, examples: list[tuple[str, str]], default: str) -> Column:
    """The example of the first keyword that the stage's text holds."""
    return F.coalesce(*[F.when(stage.contains(k), F.lit(v)) for k, v in examples], F.lit(default))


def count_check(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """(split, n, want, matches) of tables (split, n), from either side."""
    rows = counts.join(expected.select("split", F.col("n").alias("want")), "split", "full")
    return rows.select("split", "n", "want", F.col("n").eqNullSafe(F.col("want")).alias("matches"))


def error_records(rounds: DataFrame) -> DataFrame:
    """(session, round, record): one JSON document per failed round."""
    return rounds.where("not ok").select("session", "round", F.to_json(F.struct("round", "verdict", "seconds")).alias("record"))

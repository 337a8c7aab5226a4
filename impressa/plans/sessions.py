"""Queries over session ledgers.  The ledgers are derived from ``orders`` by expressions that both engines read alike, so they grow with the data;
a column ``here`` says which rows a ledger has."""

from __future__ import annotations

from pyspark.sql import functions as F

from impressa.operators import features, ledger, sessions
from impressa.plans.catalogue import IMP, _imp, _parts, query


def _mod(factor: int, n: int, shift: int = 0) -> str:
    return f"((o_orderkey * {factor} + {shift}) % {n})"


def _share(factor: int) -> str:
    """Numbers from 0 to 0.999, different for each factor."""
    return f"({_mod(factor, 1000)} / 1000e0)"


_VERDICT = "case o_orderkey * 7 % 5 when 0 then 'hit' when 1 then 'miss' when 2 then 'unclear' when 3 then 'crashed' else 'hit' end"
_CARD = "case when o_orderkey % 11 = 0 then null else 'c' || cast(o_orderkey * 13 % 17 as varchar(9)) end"
_SESSION = "o_custkey % 50"

_CARDS = {
    "run": "o_orderkey", "train_primary": f"0.5e0 + {_share(7919)} / 5", "valid_primary": f"0.5e0 + {_share(104729)} / 5", "low_gauc": f"case when o_orderkey % 7 = 0 then null else 0.6e0 + {_share(31)} / 10 end", "low_share": _share(37), "high_gauc": f"0.6e0 + {_share(41)} / 10",
    "gauc": f"{_mod(3, 10)} / 10e0", "ndcg": f"{_mod(7, 10)} / 10e0", "prev_gauc": f"case when o_orderkey % 5 = 0 then null else {_mod(11, 10)} / 10e0 end", "prev_ndcg": f"case when o_orderkey % 5 = 0 then null else {_mod(13, 10)} / 10e0 end", "seen_gauc": f"0.6e0 + {_share(53)} / 10", "unseen_gauc": f"0.6e0 + {_share(59)} / 10",
    "falls": f"{_mod(61, 9)} = 0", "mixed_share": _share(67), "best_epoch": _mod(71, 5), "epochs": _mod(73, 5), "seconds": f"{_mod(79, 2000)} * 1e0", "budget": "21600e0", "sd": f"case when o_orderkey % 3 = 0 then null else {_share(83)} / 250 end",
    "rows_match": f"{_mod(89, 50)} <> 0", "nonfinite": f"case when {_mod(97, 40)} = 0 then 3 else 0 end", "distinct_scores": _mod(101, 60),
    "low_band": f"case when o_orderkey % 3 = 0 then null else {_share(107)} / 10 end", "primary_band": f"case when o_orderkey % 4 = 0 then null else {_share(109)} / 5 end", "loss": "case o_orderkey % 3 when 0 then 'bce' when 1 then 'bpr' else null end"}
_REFLECTIONS = {
    "id": "o_orderkey", "session": _SESSION, "effect": f"{_mod(3, 6)} <> 0", "verdict": _VERDICT, "prior_delta": f"({_mod(17, 51)} - 25) / 100e0", "gain_a": f"({_mod(19, 41)} - 20) / 10000e0", "gain_b": f"({_mod(23, 41)} - 20) / 10000e0",
    "band_a": f"case when o_orderkey % 4 = 0 then null else {_mod(29, 30)} / 10000e0 end", "band_b": f"{_mod(31, 30)} / 10000e0", "promote": f"{_mod(37, 4)} = 0"}
_PROPOSALS = {
    "session": _SESSION, "id": "o_orderkey", "place": _mod(3, 5), "expected_a": f"({_mod(5, 141)} - 70) / 1000e0", "expected_b": f"({_mod(7, 141)} - 70) / 1000e0", "multiplier": f"{_mod(11, 40)} / 20e0", "difficulty": "case o_orderkey % 5 when 0 then 'config' when 1 then 'easy' when 2 then 'medium' when 3 then 'hard' else 'odd' end",
    "rationale": "case o_orderkey % 4 when 0 then '值得一试 0.1' when 1 then 'none' else 'gap 0.04' end", "how_to": "case o_orderkey % 6 when 0 then ' ' when 1 then ' set rate to 0.1' else 'do ' || cast(o_orderkey as varchar(20)) end", "card": _CARD, "novel": f"{_mod(13, 3)} = 0", "target": "'s' || cast(o_orderkey % 4 as varchar(9))"}
_ROUNDS = {
    "session": _SESSION, "round": "o_orderkey", "seq": "o_orderkey", "card": _CARD, "verdict": _VERDICT, "beats": f"{_mod(3, 4)} <> 0", "improved": f"{_mod(5, 3)} = 0", "ok": f"{_VERDICT} <> 'crashed'", "score": f"case when {_mod(7, 9)} = 0 then null else {_mod(11, 100)} / 100e0 end",
    "tokens": _mod(13, 9000), "seconds": _mod(17, 90), "train_seconds": _mod(19, 60), "interventions": _mod(23, 3), "recoveries": _mod(29, 2), "fidelity": "case o_orderkey % 3 when 0 then 'low' when 1 then 'medium' else 'high' end",
    "findings": _mod(31, 3), "proposals": _mod(37, 4), "patched": f"{_mod(41, 5)} <> 0", "reflected": f"{_mod(43, 7)} <> 0", "role": "case o_orderkey % 4 when 0 then 'diagnose' when 1 then 'propose' when 2 then 'write' else 'reflect' end"}


def _rows(spark, d, columns):
    return spark.read.parquet(f"{d}/orders.parquet").select(*[F.expr(e).alias(c) for c, e in columns.items()])


def _sql(columns):
    return "(select " + ", ".join(f"{e} as {c}" for c, e in columns.items()) + " from orders)"


def _literal(spark, rows, names):
    return spark.sql(f"select * from values {rows} as t({names})")


_RULES = (
    ("cold_items", "high_gauc - low_gauc > coalesce(low_band, 0.03e0) and low_share > 0.2e0"), ("opposite_moves", "(gauc - prev_gauc > 0 and ndcg - prev_ndcg <= 0) or (ndcg - prev_ndcg > 0 and gauc - prev_gauc <= 0)"), ("memorising", "train_primary - valid_primary > coalesce(primary_band, 0.04e0)"),
    ("cold_users", "seen_gauc - unseen_gauc >= 0.03e0"), ("drift", "falls or (train_primary - valid_primary > coalesce(primary_band, 0.04e0) and train_primary < 0.6e0)"), ("degenerate_users", "mixed_share < 0.6e0"), ("underfit", "train_primary - valid_primary < 0.02e0 and best_epoch = epochs"), ("slow", "seconds / budget > 0.05e0"), ("unstable", "sd > 0.002e0"),
    ("mismatch", "not rows_match or nonfinite > 0 or distinct_scores <= 1"), ("pointwise_loss", "loss in ('bce', 'logloss', 'mse')"))


@query(" union all ".join(f"select run, '{n}' as symptom from {_sql(_CARDS)} where {c}" for n, c in _RULES))
def symptom_rules(spark, d):
    return sessions.symptom_rules(_rows(spark, d, _CARDS))


_FINDINGS = {"run": "o_orderkey - o_orderkey % 2", "symptom": f"case {_mod(3, 5)} when 0 then 'memorising' when 1 then 'mismatch' when 2 then 'drift' else 'slow' end", "severity": _share(113)}


@query(f"""select run from {_sql(_CARDS)} c where abs(train_primary - valid_primary) > 0.15e0
    and coalesce((select max(severity) from {_sql(_FINDINGS)} f where f.run = c.run and symptom in ('memorising', 'mismatch')), 0) < 0.7e0""")
def danger_gate(spark, d):
    return sessions.danger_gate(_rows(spark, d, _CARDS), _rows(spark, d, _FINDINGS))


_TARGETS = {"id": "o_orderkey", "symptom": "'s' || cast(o_orderkey % 3 as varchar(9))"}
_ITEMS = tuple({"id": "o_orderkey", "symptom": f"'s' || cast({k} as varchar(9))", "before": f"{_mod(3 + k, 4)} / 10e0", "after": f"{_mod(5 + k, 4)} / 10e0", "resolved": f"case {_mod(7 + k, 3)} when 0 then 'yes' when 1 then 'partly' else 'no' end", "here": f"{_mod(11 + 2 * k, 8)} < 5"} for k in range(4))
_ITEM_SQL = "(" + " union all ".join(f"select id, symptom, before, after, resolved from {_sql(i)} where here" for i in _ITEMS) + ")"
_REFLECTION_RULES = (
    ("no_effect_hit", "not effect and verdict = 'hit'"), ("no_effect_penalty", "not effect and prior_delta < 0"), ("too_many_resolved", "told > 3"), ("prior_step", "abs(prior_delta) > 0.2e0"),
    ("within_noise", "verdict = 'hit' and not (abs(gain_a) >= greatest(0.0005e0, coalesce(band_a, 0e0)) or abs(gain_b) >= greatest(0.0005e0, coalesce(band_b, 0e0)))"), ("target_missing", "missing"), ("resolved_unchanged", "same"), ("hit_unresolved", "verdict = 'hit' and coalesce(none, true)"),
    ("hit_without_gain", "verdict = 'hit' and gain_a <= 0 and gain_b <= 0"), ("miss_rewarded", "verdict = 'miss' and prior_delta > 0"), ("unclear_step", "verdict = 'unclear' and abs(prior_delta) > 0.05e0"), ("promote_without_hit", "promote and verdict <> 'hit'"))


@query(f"""with i as {_ITEM_SQL}, a as (select id, count(*) as told, bool_or(resolved <> 'no' and abs(after - before) < 1e-9) as same, bool_and(resolved = 'no') as none from i group by id
), t as (select t.id, bool_or(i.id is null) as missing from {_sql(_TARGETS)} t left join i on i.id = t.id and i.symptom = t.symptom group by t.id
), r as (select r.*, told, same, none, missing from {_sql(_REFLECTIONS)} r left join a on a.id = r.id left join t on t.id = r.id)
""" + " union all ".join(f"select id, '{n}' as rule from r where {c}" for n, c in _REFLECTION_RULES))
def reflection_violations(spark, d):
    items = None
    for i in _ITEMS:
        own = _rows(spark, d, i).where("here").drop("here")
        items = own if items is None else items.unionByName(own)
    return sessions.reflection_violations(_rows(spark, d, _REFLECTIONS), _rows(spark, d, _TARGETS), items)


_CANDIDATES = "('c1', 'first set rate to 0.1 and then more'), ('c2', ''), ('c3', 'x'), ('c4', 'y'), ('c5', 'do 1')"
_TOP = {"session": "o_custkey % 45", "symptom": "'s' || cast(o_custkey % 45 % 5 as varchar(9))"}
_PROPOSAL_RULES = (
    ("place", "place < 1 or place > 3"), ("expected", "greatest(abs(expected_a), abs(expected_b)) > 0.05e0"), ("multiplier", "multiplier < 0.1e0"), ("hedge", " or ".join(f"contains(rationale, '{w}')" for w in sessions.HEDGES)), ("no_number", "not regexp_matches(rationale, '[0-9]')"),
    ("no_how_to", "trim(how_to) = ''"), ("copied_how_to", "how <> '' and contains(how, substring(trim(how_to), 1, 40))"), ("unknown_card", "not novel and how is null"))


@query(f"""with p as (select p.*, c.how from {_sql(_PROPOSALS)} p left join (values {_CANDIDATES}) c(card, how) on c.card = p.card
), t as (select distinct session, symptom from {_sql(_TOP)}
), w as (select p.session, count(*) as n, bool_or(target = symptom) as hit, max(symptom) as top from p left join t on t.session = p.session group by p.session)
""" + " union all ".join(f"select session, id, '{n}' as rule from p where {c}" for n, c in _PROPOSAL_RULES) + " union all select session, cast(null as bigint), 'too_many' from w where n > 3 union all select session, cast(null as bigint), 'top_untargeted' from w where top is not null and not coalesce(hit, false)")
def proposal_violations(spark, d):
    top = _rows(spark, d, _TOP).distinct()
    return sessions.proposal_violations(_rows(spark, d, _PROPOSALS), _literal(spark, _CANDIDATES, "card, how_to"), top)


_TRUST = _ROUNDS | {"card": "o_orderkey % 997"}


@query(f"""with recursive s as (
    select card, row_number() over (partition by card order by seq) as k, (case when verdict = 'hit' and beats then 0.15e0 else 0e0 end) + (case when improved then 0.05e0 else 0e0 end) + (case verdict when 'miss' then -0.1e0 when 'crashed' then -0.15e0 else 0e0 end) as delta
    from {_sql(_TRUST)}
), f as (
    select card, k, greatest(0.05e0, least(0.95e0, 0.5e0 + delta)) as prior from s where k = 1
    union all select s.card, s.k, greatest(0.05e0, least(0.95e0, f.prior + s.delta)) from f join s on s.card = f.card and s.k = f.k + 1
) select card, arg_max(prior, k) as prior from f group by card""")
def trust_from_verdicts(spark, d):
    return sessions.trust_from_verdicts(_rows(spark, d, _TRUST).withColumn("prior", F.lit(0.5)))


_PRIORS = "('c1', 0.6e0), ('c2', 0.3e0), ('c3', 0.9e0), ('c4', 0.5e0), ('c5', 0.05e0)"
_MEASURED = "('c1', 2e0), ('c3', 0.01e0)"
_TRIED = {"session": _SESSION, "card": "'c' || cast(o_orderkey % 17 as varchar(9))", "here": "o_orderkey % 20 = 0"}
_TIGHT = "(1), (2), (3), (7), (49)"


@query(f"""with x as (select distinct session, card from {_sql(_TRIED)} where here
), p as (select p.session, id, p.card, difficulty, (greatest(0e0, expected_a) + greatest(0e0, expected_b)) * coalesce(c.prior, 0.5e0) / ((case difficulty when 'config' then 0.5e0 when 'easy' then 1e0 when 'medium' then 2e0 when 'hard' then 3e0 else 2e0 end) * greatest(0.1e0, coalesce(m.m, multiplier))) as score,
        x.card is null as fresh, p.session in (select * from (values {_TIGHT}) v(s)) as tight
    from {_sql(_PROPOSALS)} p left join (values {_PRIORS}) c(card, prior) on c.card = p.card left join (values {_MEASURED}) m(card, m) on m.card = p.card left join x on x.session = p.session and x.card = p.card
), a as (select * from (select *, bool_or(fresh) over (partition by session) as any_fresh from p) where fresh or not any_fresh
), e as (select * from (select *, difficulty in ('config', 'easy') as easy, bool_or(difficulty in ('config', 'easy')) over (partition by session) as any_easy from a) where not tight or easy or not any_easy)
select session, id, score, row_number() over (partition by session order by score desc, id) as place from e""")
def scheduler_by_session(spark, d):
    proposals = _rows(spark, d, _PROPOSALS).withColumn("expected", F.create_map(F.lit("a"), F.col("expected_a"), F.lit("b"), F.col("expected_b")))
    tried = _rows(spark, d, _TRIED).where("here")
    return sessions.schedule(proposals, _literal(spark, _PRIORS, "card, prior"), _literal(spark, _MEASURED, "card, multiplier"), tried, _literal(spark, _TIGHT, "session"))


@query(f"""select session, count(*) as rounds, count(*) filter (where verdict = 'hit') as hits, cast(sum(tokens) as bigint) as tokens, sum(seconds) / 60e0 as minutes, sum(train_seconds) / 60e0 as train_minutes,
    cast(sum(interventions) as bigint) as interventions, cast(sum(recoveries) as bigint) as recoveries, count(score) as scored from {_sql(_ROUNDS)} group by session""")
def session_totals(spark, d):
    return sessions.session_totals(_rows(spark, d, _ROUNDS))


@query(f"select role, count(*) as calls, cast(sum(seconds) as bigint) as seconds, cast(sum(tokens) as bigint) as tokens from {_sql(_ROUNDS)} group by role")
def step_costs(spark, d):
    return sessions.step_costs(_rows(spark, d, _ROUNDS))


@query(f"select distinct session, card, case when verdict = 'hit' then 'applied' else 'blocked' end as state from {_sql(_ROUNDS)} where card is not null and verdict in ('hit', 'miss', 'crashed')")
def card_memory(spark, d):
    return sessions.card_memory(_rows(spark, d, _ROUNDS))


@query(f"select session, card from {_sql(_ROUNDS)} where card is not null and verdict = 'hit' union select session, card from {_sql(_ROUNDS)} where card is not null and verdict in ('miss', 'crashed')")
def excluded_cards(spark, d):
    return sessions.excluded(sessions.card_memory(_rows(spark, d, _ROUNDS)))


_REPORTS = {"run": "o_orderkey", "gauc": f"case when o_orderkey % 6 = 0 then null else {_share(3)} end", "ndcg": f"case when o_orderkey % 4 = 0 then null else {_share(7)} end", "primary_score": f"case o_orderkey % 3 when 0 then null when 1 then ({_share(3)} + {_share(7)}) / 2 else {_share(11)} end"}


@query(f"select run, coalesce(primary_score, gauc + coalesce(ndcg, 0e0), cast('-inf' as double)) as total from {_sql(_REPORTS)}")
def report_scores(spark, d):
    return sessions.scores_of(_rows(spark, d, _REPORTS))


@query(f"select run from {_sql(_REPORTS)} where abs(primary_score - (gauc + ndcg) / 2) > 1e-6")
def envelope_errors(spark, d):
    return sessions.envelope_errors(_rows(spark, d, _REPORTS))


_BEST = tuple({"session": "o_orderkey", "metric": f"'{m}'", "value": f"0.5e0 + {_share(f)} / 10"} for m, f in (("GAUC", 3), ("nDCG", 7), ("other", 11)))
_HOLDOUT = tuple({"session": "o_orderkey", "metric": f"'{m}'", "value": f"0.5e0 + {_share(f)} / 10", "here": f"{_mod(f, 5)} <> 0"} for m, f in (("GAUC", 13), ("nDCG", 17)))
_BASE = "('GAUC', 0.55e0), ('nDCG', 0.53e0)"


@query(f"""with b as ({' union all '.join(f'select * from {_sql(x)}' for x in _BEST)}), h as ({' union all '.join(f'select * from {_sql(x)} where here' for x in _HOLDOUT)})
select b.session, b.metric, b.value - base.v as delta, b.value - h.value as gap, abs(b.value - base.v) <= 0.003e0 as reproduced from b left join (values {_BASE}) base(metric, v) on base.metric = b.metric left join h on h.session = b.session and h.metric = b.metric""")
def metric_deltas(spark, d):
    best = [_rows(spark, d, x) for x in _BEST]
    held = [_rows(spark, d, x).where("here").drop("here") for x in _HOLDOUT]
    return sessions.metric_deltas(best[0].unionByName(best[1]).unionByName(best[2]), _literal(spark, _BASE, "metric, value"), held[0].unionByName(held[1]), 0.003)


_BANDS = "('low', 'GAUC', 0.0054e0), ('low', 'nDCG', 0.0024e0), ('medium', 'GAUC', 0.0042e0)"


@query(f"select session, round, metric, band from {_sql(_ROUNDS)} r join (values {_BANDS}) b(fidelity, metric, band) on b.fidelity = r.fidelity")
def usable_bands(spark, d):
    return sessions.usable_bands(_literal(spark, _BANDS, "fidelity, metric, band"), _rows(spark, d, _ROUNDS))


_ROUND_TARGETS = {"session": _SESSION, "round": "o_orderkey", "symptom": "'s' || cast(o_orderkey % 3 as varchar(9))"}


@query(f"select r.session, r.round, symptom, 'no' as resolved, -0.15e0 as prior_delta from {_sql(_ROUNDS)} r join {_sql(_ROUND_TARGETS)} t on t.session = r.session and t.round = r.round where not ok")
def crashed_reflections(spark, d):
    return sessions.crashed_reflections(_rows(spark, d, _ROUNDS), _rows(spark, d, _ROUND_TARGETS))


@query(f"select session, round, case when findings <= 0 then 'diagnosis' when proposals <= 0 then 'proposal' when not patched then 'patch' when not reflected then 'reflection' end as stage from {_sql(_ROUNDS)}")
def stage_progress(spark, d):
    return sessions.stage_of(_rows(spark, d, _ROUNDS))


@query(f"""with a as (select session, seq, count(*) over w as n, sum(seconds) over w as used from {_sql(_ROUNDS)} window w as (partition by session order by seq rows between unbounded preceding and current row))
select session, seq, cast(greatest(0, 50 - n) as bigint) as attempts_left, greatest(0e0, 900e0 - used) as seconds_left, case when used / 900e0 >= 0.85e0 then 2 when used / 900e0 >= 0.6e0 then 1 else 0 end as tier from a""")
def budget_accounts(spark, d):
    return sessions.budget_left(_rows(spark, d, _ROUNDS), 50, 900.0)


_SNAPSHOTS = {"session": _SESSION, "round": "o_orderkey % 400", "path": "'p' || cast(o_orderkey % 5 as varchar(9))", "owner": "o_orderkey % 300"}
_FILES = {"session": _SESSION, "round": "o_orderkey % 300", "path": "'p' || cast(o_orderkey % 5 as varchar(9))", "content": "'text ' || cast(o_orderkey % 300 as varchar(9))", "here": f"{_mod(3, 29)} <> 0"}


@query(f"""with f as (select distinct session, round, path, content from {_sql(_FILES)} where here), s as (select distinct * from {_sql(_SNAPSHOTS)}
), j as (select s.session, s.round, s.path, f.content, bool_and(f.content is not null) over (partition by s.session, s.round) as whole from s left join f on f.session = s.session and f.round = s.owner and f.path = s.path)
select session, round, path, content from j where whole""")
def snapshot_restore(spark, d):
    return sessions.restore_snapshots(_rows(spark, d, _SNAPSHOTS).distinct(), _rows(spark, d, _FILES).where("here").drop("here").distinct())


@query(f"""select session, round, score from (select *, row_number() over (partition by session order by score desc, round) as k from {_sql(_ROUNDS)} where ok and score is not null) where k = 1""")
def best_rounds(spark, d):
    return sessions.best_rounds(_rows(spark, d, _ROUNDS))


_TAGS = {"id": "o_orderkey", "a": "'s' || cast(o_orderkey % 9 as varchar(9))", "b": "'t' || cast(o_orderkey % 4 as varchar(9))"}
_KNOWN = "('s1'), ('s2'), ('s3'), ('t0'), ('t2')"


@query(f"select id, tag from (select id, unnest([a, b]) as tag from {_sql(_TAGS)}) where tag not in (select * from (values {_KNOWN}) v(t))")
def unknown_tags(spark, d):
    return sessions.unknown_tags(_rows(spark, d, _TAGS).select("id", F.array("a", "b").alias("tags")), _literal(spark, _KNOWN, "tag"))


_EXAMPLES = [("pro", "a plan"), ("dia", "a finding"), ("o", "a text")]


@query(f"select round, case when contains(role, 'pro') then 'a plan' when contains(role, 'dia') then 'a finding' when contains(role, 'o') then 'a text' else 'none' end as example from {_sql(_ROUNDS)}")
def stage_examples(spark, d):
    return _rows(spark, d, _ROUNDS).select("round", sessions.example_for(F.col("role"), _EXAMPLES, "none").alias("example"))


_KEYS = {"id": "o_orderkey", "a": _share(3), "b": _share(7)}


@query(f"select id, 'score' as key, a as value from {_sql(_KEYS)}")
def report_without_baseline(spark, d):
    rows = _rows(spark, d, _KEYS).select("id", F.create_map(F.lit("score"), F.col("a"), F.lit("official score"), F.col("b"), F.lit("baseline GAUC"), F.col("b")).alias("report"))
    return sessions.without_keys(rows, "report", ["official", "baseline"]).select("id", F.explode("report"))


_EXPECTED = "('train', cast(3 as bigint)), ('valid', cast(2328 as bigint)), ('gone', cast(5 as bigint))"


@query(f"""with {IMP}, c as (select split, count(*) as n from imp group by split)
select coalesce(c.split, e.split) as split, c.n, e.n as want, c.n is not distinct from e.n as matches from c full join (values {_EXPECTED}) e(split, n) on e.split = c.split""")
def split_count_check(spark, d):
    counts = _imp(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return sessions.count_check(counts, spark.sql(f"select split, n from values {_EXPECTED.replace('bigint', 'long')} as t(split, n)"))


@query(f"""select session, round, '{{"round":' || cast(round as varchar) || ',"verdict":"' || verdict || '","seconds":' || cast(seconds as varchar) || '}}' as record from {_sql(_ROUNDS)} where not ok""")
def error_records(spark, d):
    return sessions.error_records(_rows(spark, d, _ROUNDS))


@query(f"with {IMP} select row_id, row_number() over (order by row_id) - 1 as place from valid")
def contiguous_row_ids(spark, d):
    return features.placed(_parts(spark, d)[1].select("row_id"), "row_id", [], "place")


@query(f"""with {IMP}, e as (select item_id, (sum(label) + 20e0 * (select g from g)) / (count(*) + 20e0) as e from train where item_id < '50' group by item_id)
select row_id, coalesce(e, (select g from g)) as encoding from valid left join e using (item_id)""")
def target_encoding_valid(spark, d):
    train, valid = _parts(spark, d)
    # rare values are left out of the table, so some rows fall back to the mean
    known = train.withColumn("item_id", F.when(F.col("item_id") < "50", F.col("item_id")))
    return features.apply_target_encoding(valid, known, "item_id").select("row_id", "encoding")


@query(f"""with {IMP}, e as (select list_distinct(quantile_cont(duration, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) as e from train
), v as (select cast(author_id as double) as a, row_number() over (order by min(row_id), author_id) as code from train where author_id <> 3 group by author_id)
select row_id, 1 + len(list_filter(e, lambda x: x <= duration)) as duration_code, coalesce(code, 0) as author_code from valid cross join e left join v on v.a = author_id""")
def auto_binned_codes(spark, d):
    train, valid = _parts(spark, d)
    valid = valid.withColumn("author", F.col("author_id").cast("double"))
    train = train.withColumn("author", F.when(F.col("author_id") != 3, F.col("author_id").cast("double")))
    out = features.auto_codes(valid, train, "duration", 8).withColumnRenamed("code", "duration_code")
    return features.auto_codes(out, train, "author", 10).select("row_id", F.col("duration_code").cast("long").alias("duration_code"), F.col("code").cast("long").alias("author_code"))

"""Named queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.functions import text as tx
from impressa.operators import features, fm, lambdarank, ledger, metrics, models, plugins, sampling
from impressa.sources import impressions, ledgers, ordered, predictions, shared
from impressa.streaming import events as live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The impression adapter in SQL; the splits are those of impressions.EVENT_SPLITS.
IMP = """raw as (
    select event_id as row_id, user_id, json_extract_string(props, '$.k') as item_id, cast(json_extract_string(props, '$.k') as integer) % 10 as author_id, event_type as tab, value as duration,
        case when event_type = 'purchase' then 1 else 0 end as label, cast(strftime(ts, '%Y%m%d') as integer) as date from events
), imp as (
    select *, case when date between 20240101 and 20240114 then 'train' when date between 20240115 and 20240121 then 'valid' when date between 20240122 and 20240130 then 'test' end as split
    from raw where date between 20240101 and 20240130
), train as (select * from imp where split = 'train'), valid as (select * from imp where split = 'valid'
), g as (select avg(label) as g from train
), pop as (select item_id, count(*) as n, sum(label) as s from train group by item_id
), scored as (select v.*, coalesce((s + 20e0 * g) / (n + 20e0), g) as score from valid v left join pop using (item_id) cross join g)"""

USER = """u as (
    select {key}, count(*) as n, sum(label) as p, sum(case when label = 1 then r end) as ranks,
        sum(case when pos <= 5 then (2e0 ** label - 1) / log2(pos + 1e0) else 0e0 end) as dcg, sum(case when best <= 5 then (2e0 ** label - 1) / log2(best + 1e0) else 0e0 end) as idcg
    from (select *, rank() over (partition by {key} order by score) + (count(*) over (partition by {key}, score) - 1) / 2e0 as r,
        row_number() over (partition by {key} order by score desc, row_id) as pos, row_number() over (partition by {key} order by label desc, row_id) as best from {src})
    group by {key}
), m as (select *, case when p > 0 and p < n then (ranks - p * (p + 1) / 2e0) / (p * (n - p)) end as auc, case when idcg > 0 then dcg / idcg else 0e0 end as ndcg from u)"""

TOTAL = """coalesce(sum(auc * p) / nullif(sum(case when auc is not null then p end), 0), 0.5e0) as gauc, coalesce(avg(ndcg), 0e0) as ndcg,
    cast(coalesce(sum(n), 0) as bigint) as n_rows, cast(coalesce(sum(p), 0) as bigint) as positives, count(*) as users,
    (coalesce(sum(auc * p) / nullif(sum(case when auc is not null then p end), 0), 0.5e0) + coalesce(avg(ndcg), 0e0)) / 2 as primary_score"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _imp(spark, d):
    return impressions.from_events(spark, d)


def _parts(spark, d):
    imp = _imp(spark, d)
    return imp.where("split = 'train'"), imp.where("split = 'valid'")


def _scored(spark, d):
    train, valid = _parts(spark, d)
    return features.popularity_scores(valid, train), train


@query(f"with {IMP}, {USER.format(key='user_id', src='scored')} select {TOTAL} from m")
def popularity_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_metrics(_scored(spark, sf_dir)[0])


@query(f"with {IMP}, {USER.format(key='user_id', src='scored')} select user_id, n, cast(p as bigint) as positives, auc, dcg, idcg, ndcg from m")
def auc_by_user(spark, d):
    return metrics.user_metrics(_scored(spark, d)[0])


@query(f"with {IMP}, l as (select * exclude (score), cast(label as double) as score from scored), {USER.format(key='user_id', src='l')} select {TOTAL} from m")
def oracle_ceiling(spark, d):
    return metrics.ranking_metrics(_parts(spark, d)[1].withColumn("score", F.col("label").cast("double")))


@query(f"with {IMP} select split, count(*) as n, cast(sum(case when split = 'test' then null else label end) as bigint) as positives from imp group by split")
def split_counts(spark, d):
    return impressions.hide_labels(_imp(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


@query(f"""with {IMP}, u as (select user_id, count(*) as n, sum(label) as p from valid group by user_id)
select count(*) as users, count(*) filter (where p > 0 and p < n) as gauc_users, count(*) filter (where p > 0 and p < n) / count(*)::double as gauc_share,
    count(*) filter (where p = 0) / count(*)::double as zero_pos_share, count(*) filter (where p = n) / count(*)::double as all_pos_share from u""")
def label_composition(spark, d):
    return metrics.label_composition(_parts(spark, d)[1])


_CARD = f"""with {IMP}, dealt as (
    select row_id, user_id, label, score, 'exposure' as dim, case when coalesce(n, 0) >= 1000 then '1000+' when coalesce(n, 0) >= 100 then '100-999' when coalesce(n, 0) >= 10 then '10-99' else '0-9' end as grp from scored left join pop using (item_id)
    union all select row_id, user_id, label, score, 'seen', case when user_id in (select user_id from train) then 'seen' else 'unseen' end from scored
    union all select row_id, user_id, label, score, 'date', cast(date as varchar) from scored
    union all select row_id, user_id, label, score, 'all', 'all' from scored
), {USER.format(key='dim, grp, user_id', src='dealt')}, t as (select dim, grp, {TOTAL} from m group by dim, grp
), fixed(dim, grp) as (values ('exposure', '0-9'), ('exposure', '10-99'), ('exposure', '100-999'), ('exposure', '1000+'), ('seen', 'seen'), ('seen', 'unseen')
), every as (select dim, grp from t union select dim, grp from fixed)
select dim, grp, coalesce(n_rows, 0) as n_rows, coalesce(positives, 0) as positives, coalesce(users, 0) as users, coalesce(n_rows / (select n_rows from t where dim = 'all')::double, 0) as share,
    case when n_rows >= 200 and positives > 0 and positives < n_rows then gauc end as gauc, case when n_rows >= 200 and positives > 0 and positives < n_rows then ndcg end as ndcg,
    case when n_rows >= 200 and positives > 0 and positives < n_rows then primary_score end as primary_score from every left join t using (dim, grp)"""


def _card(dim):
    def f(spark, d):
        train, valid = _parts(spark, d)
        return metrics.scorecard(features.popularity_scores(valid, train, exposures="exposures"), train).where(F.col("dim") == dim)

    return f


for _name, _dim in (("exposure_bucket_metrics", "exposure"), ("seen_user_metrics", "seen"), ("date_metrics", "date")):
    QUERIES[_name], ORACLE[_name] = _card(_dim), f"select * from ({_CARD}) where dim = '{_dim}'"


@query(_CARD)
def scorecard(spark, d):
    train, valid = _parts(spark, d)
    return metrics.scorecard(features.popularity_scores(valid, train, exposures="exposures"), train)


@query(f"with {IMP} select count(*) as pred_rows, cast(0 as bigint) as nonfinite, min(score) as min_score, max(score) as max_score, count(distinct score) as distinct_scores from scored")
def prediction_health(spark, d):
    return predictions.health(_scored(spark, d)[0])


@query(f"""with {IMP}, p as (select row_id, user_id, case when row_id % 97 = 0 then 'x' else item_id end as item_id, score from scored where row_id % 101 <> 0
), j as (select v.row_id, v.user_id as u, v.item_id as i, p.row_id as r, p.user_id as pu, p.item_id as pi, p.score from valid v full join p on v.row_id = p.row_id
), k as (select *, not (row_id is not null and r is not null and u = pu and i = pi) or row_id is null or r is null as bad from j)
select count(row_id) as target_rows, count(r) as pred_rows, count(*) filter (where bad) as misaligned, min(case when bad then coalesce(row_id, r) end) as first_bad, cast(0 as bigint) as nonfinite,
    count(distinct score) as distinct_scores, count(*) filter (where bad) = 0 as ok from k""")
def alignment_check(spark, d):
    scored, _ = _scored(spark, d)
    bad = scored.where("row_id % 101 <> 0").withColumn("item_id", F.when(F.col("row_id") % 97 == 0, "x").otherwise(F.col("item_id")))
    return predictions.alignment(bad, _parts(spark, d)[1])


@query(f"""with {IMP}, e as (select quantile_cont(duration, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from train)
select row_id, len(list_filter(e, lambda x: x < duration)) as bucket_left, 1 + len(list_filter(list_distinct(e), lambda x: x <= duration)) as bucket_right from valid cross join e""")
def duration_buckets(spark, d):
    train, valid = _parts(spark, d)
    edges = features.quantile_edges(train, "duration", 10)
    v = F.col("duration")
    return valid.select("row_id", features.bucket_left(v, edges).cast("long").alias("bucket_left"), features.bucket_right(v, edges).cast("long").alias("bucket_right"))


@query(f"""with {IMP}, r as (select row_id, user_id, label, score, row_number() over (partition by user_id order by score desc, row_id) as k from scored
), u as (select user_id, list_sum(list_transform(range(1, cast(least(sum(label), 5) as bigint) + 1), lambda i: 1 / log2(i + 1))) as ideal from r group by user_id having sum(label) > 0 and sum(label) < count(*)
), d as (select r.*, ideal, case when k <= 5 then 1 / log2(k + 1) else 0 end as d from r join u using (user_id)
), p as (select a.row_id, 2 * b.label - 1 as sign, 1 / (1 + exp((2 * a.label - 1) * (a.score - b.score))) as q, abs(a.d - b.d) / a.ideal as w from d a join d b on a.user_id = b.user_id and a.label <> b.label
), gh as (select row_id, sum(sign * q * w) as g, sum(q * (1 - q) * w) as h from p group by row_id)
select row_id, coalesce(gh.g, 0) as g, coalesce(gh.h, 0) as h from scored left join gh using (row_id)""")
def lambda_gradients(spark, d):
    """Derivatives of the ranking loss by each row's popularity score."""
    return lambdarank.lambdas(_scored(spark, d)[0])


@query()
def ranking_trees_metrics(spark, d):
    """Ranking trees fitted on train; metrics on the valid split."""
    train, valid = (features.popularity_scores(x, _parts(spark, d)[0]).withColumnRenamed("score", "popularity") for x in _parts(spark, d))
    model = lambdarank.LambdaRank(["duration", "popularity"], trees=3, depth=2).fit(train)
    return metrics.ranking_metrics(model.predict(valid))


@query(f"with {IMP} select row_id, label, coalesce((s + 20e0 * g) / (n + 20e0), g) as encoding, coalesce(n, 0) as frequency from valid left join pop using (item_id) cross join g")
def feature_plugins(spark, d):
    """Two feature plug-ins fitted on train, applied to the valid split without its labels."""
    train, valid = _parts(spark, d)
    _, (rows,), _, _ = plugins.apply([plugins.TargetEncoder(field="item_id"), plugins.FrequencyEncoder(field="item_id")], train, [valid])
    return rows.select("row_id", "label", "encoding", "frequency")


@query(f"""with {IMP}, v as (select item_id, row_number() over (order by min(row_id), item_id) - 1 as code from train group by item_id), w as (select user_id, row_number() over (order by min(row_id), user_id) - 1 as code from train group by user_id)
select row_id, coalesce(v.code, (select count(*) from v)) as item_id_code, coalesce(w.code, (select count(*) from w)) as user_id_code from valid left join v using (item_id) left join w using (user_id)""")
def vocab_encode(spark, d):
    train, valid = _parts(spark, d)
    return features.encode(valid, train, ["item_id", "user_id"]).select("row_id", "item_id_code", "user_id_code")


@query(f"""with {IMP}, c as (select 'user_id' as field, 0 as position, count(distinct user_id) + 1 as cardinality from train union all select 'item_id', 1, count(distinct item_id) + 1 from train union all select 'tab', 2, count(distinct tab) + 1 from train)
select *, cast(coalesce(sum(cardinality) over (order by position rows between unbounded preceding and 1 preceding), 0) as bigint) as first from c""")
def field_offsets(spark, d):
    return features.field_offsets(_parts(spark, d)[0], ["user_id", "item_id", "tab"])


@query(f"with {IMP} select item_id, n, cast(s as bigint) as positives, (s + 20e0 * g) / (n + 20e0) as rate, g as mean from pop cross join g")
def popularity_scores(spark, d):
    return features.popularity(_parts(spark, d)[0])


@query(f"with {IMP} select item_id as value, (s + 20e0 * g) / (n + 20e0) as encoding from pop cross join g where item_id is not null")
def target_encoding_full(spark, d):
    return features.target_encoding(_parts(spark, d)[0], "item_id")


@query(f"""with {IMP}, c as (select item_id, row_id % 5 as f, sum(label) as s, count(*) as n from train group by all
), t as (select item_id, f, sum(s) over (partition by item_id) - s as s, sum(n) over (partition by item_id) - n as n from c)
select row_id, (s + 20e0 * g) / (n + 20e0) as encoding from train join t on train.item_id = t.item_id and train.row_id % 5 = t.f cross join g""")
def target_encoding_oof(spark, d):
    return features.target_encoding_oof(_parts(spark, d)[0], "item_id", F.col("row_id") % 5).select("row_id", "encoding")


def _bucket_sql(op):
    return f"with {IMP} select row_id, coalesce(n, 0) as n, len(list_filter([10, 70, 140], lambda e: e {op} coalesce(n, 0))) as bucket from valid left join pop using (item_id)"


@query(_bucket_sql("<="))
def frequency_bucket_lt(spark, d):
    train, valid = _parts(spark, d)
    return features.frequency(valid, train, "item_id").select("row_id", "n", features.frequency_bucket(F.col("n"), [10, 70, 140]).cast("long").alias("bucket"))


@query(_bucket_sql("<"))
def frequency_bucket_gt(spark, d):
    train, valid = _parts(spark, d)
    return features.frequency(valid, train, "item_id").select("row_id", "n", features.frequency_bucket(F.col("n"), [10, 70, 140], False).cast("long").alias("bucket"))


@query(f"""with {IMP}, k as (select t.item_id, t.author_id, n, max(n) over () as m from train t join pop using (item_id)), cat as (select author_id, avg(n) as c from k where n >= 50 or m < 50 group by author_id)
select row_id, (1 - (1 - least(1e0, coalesce(n, 0) / 50e0))) * coalesce(n, 0) + (1 - least(1e0, coalesce(n, 0) / 50e0)) * coalesce(c, 0e0) as blend from valid left join pop using (item_id) left join cat using (author_id)""")
def category_fallback(spark, d):
    train, valid = _parts(spark, d)
    return features.category_fallback(valid, train, "item_id", "author_id", 50).select("row_id", "blend")


@query(f"""with {IMP}, c as (select label, greatest(1, round_even(count(*) * 0.15e0, 0)) as m from train group by label)
select row_id, label from (select row_id, t.label, m, row_number() over (partition by t.label order by row_id) as p from train t join c on t.label = c.label) where p <= m""")
def stratified_sample(spark, d):
    return sampling.stratified(_parts(spark, d)[0], 0.15, "row_id").select("row_id", "label")


@query(f"""with {IMP}, c as (select user_id, count(*) as n from train group by user_id), b as (select user_id, coalesce(sum(n) over (order by user_id rows between unbounded preceding and 1 preceding), 0) as b from c)
select row_id, user_id from train where user_id in (select user_id from b where b < 2000)""")
def whole_user_sample(spark, d):
    return sampling.whole_users(_parts(spark, d)[0], 2000, F.col("user_id")).select("row_id", "user_id")


#: CRC-32 of a text of one-byte characters, bit by bit; 3988292384 is its reversed polynomial.
_CRC32 = """xor(list_reduce(list_transform(string_split({text}, ''), lambda s: cast(ascii(s) as bigint)),
    lambda c, b: list_reduce(range(0, 8), lambda k, z: xor(k >> 1, 3988292384 * (k & 1)), xor(c, b)), cast(4294967295 as bigint)), 4294967295)"""


@query(f"""with {IMP}, h as (select user_id, {_CRC32.format(text="cast(user_id as varchar)")} % 10000 < 2000 as holdout from (select distinct user_id from valid))
select row_id, user_id, holdout from valid join h using (user_id)""")
def holdout_crc32(spark, d):
    valid = _parts(spark, d)[1]
    return valid.select("row_id", "user_id", sampling.in_holdout(F.col("user_id"), 0.2).alias("holdout"))


@query(f"""with {IMP}, h as (select *, count(*) over w as hist_n, coalesce(sum(label) over w, 0) as s from imp window w as (partition by user_id, author_id order by date range between unbounded preceding and 1 preceding))
select row_id, hist_n, cast(s as bigint) as hist_pos, (s + 10e0) / (hist_n + 20e0) as hist_rate from h""")
def user_item_history(spark, d):
    return features.history(_imp(spark, d), ["user_id", "author_id"], "date").select("row_id", "hist_n", "hist_pos", "hist_rate")


@query(f"with {IMP} select row_id, 0.9e0 ** date_diff('day', strptime(cast(date as varchar), '%Y%m%d'), (select max(strptime(cast(date as varchar), '%Y%m%d')) from train)) as weight from train")
def time_decay_weights(spark, d):
    return features.decay_weights(_parts(spark, d)[0], F.to_date(F.col("date").cast("string"), "yyyyMMdd"), 0.9).select("row_id", "weight")


@query(f"with {IMP} select a.user_id, a.row_id as positive, b.row_id as negative from valid a join valid b on a.user_id = b.user_id and a.label = 1 and b.label = 0")
def pairwise_pairs(spark, d):
    return features.positive_negative_pairs(_parts(spark, d)[1])


@query(f"""with {IMP} select user_id, row_id, 0.7e0 * percent_rank() over (partition by user_id order by score) + 0.3e0 * percent_rank() over (partition by user_id order by duration) as score from scored""")
def percent_rank_fusion(spark, d):
    scored, _ = _scored(spark, d)
    return features.column_rank_fusion(scored, {"score": 0.7, "duration": 0.3})


@query(f"""with {IMP} select row_id, user_id, label from (select *, row_number() over (partition by user_id, label order by row_id) as p from train) where label = 1 or row_id % 4 = 0 or p <= 3""")
def negative_downsample(spark, d):
    return sampling.downsample_negatives(_parts(spark, d)[0], F.col("row_id") % 4 == 0, 3).select("row_id", "user_id", "label")


@query(f"""with {IMP} select row_id, list_transform(list_slice(h, greatest(len(h) - 4, 1), len(h)), lambda x: x.i) as recent from (
    select v.row_id, coalesce(list_sort(list({{'d': t.date, 'r': t.row_id, 'i': t.item_id}}) filter (where t.row_id is not null)), []) as h from valid v left join valid t on t.user_id = v.user_id and t.date < v.date group by v.row_id)""")
def recent_items(spark, d):
    return features.recent_items(_parts(spark, d)[1], "user_id", "date", "item_id", "row_id", 5).select("row_id", "recent")


@query(f"with {IMP} select avg(-(label * ln(greatest(1e-7, least(1 - 1e-7, score))) + (1 - label) * ln(1 - greatest(1e-7, least(1 - 1e-7, score))))) as logloss from scored")
def logloss(spark, d):
    return metrics.logloss(_scored(spark, d)[0])


@query(f"""with {IMP}, l as (select * exclude (score), cast('0x' || substring(md5('7:' || row_id), 1, 8) as bigint) / 4294967296e0 as score from scored), {USER.format(key='user_id', src='l')}
select {TOTAL} from m""")
def random_scores(spark, d):
    valid = _parts(spark, d)[1]
    return metrics.ranking_metrics(valid.withColumn("score", sampling.uniform(7, F.col("row_id"))))


_PARAMS = "(values ('tab', 'view', 0.1e0, 0.2e0, 0.3e0), ('tab', 'click', -0.2e0, 0.1e0, 0.5e0), ('author_id', '3', 0.4e0, -0.3e0, 0.2e0), ('author_id', '7', 0.05e0, 0.6e0, -0.1e0)) as t(field, value, w, v1, v2)"


@query(f"""with {IMP}, prm as (select * from {_PARAMS}), x as (select row_id, 'tab' as field, tab as value from valid union all select row_id, 'author_id', cast(author_id as varchar) from valid)
select row_id, 0.25e0 + coalesce(sum(w), 0) + coalesce((sum(v1) ** 2 - sum(v1 * v1)) / 2 + (sum(v2) ** 2 - sum(v2 * v2)) / 2, 0) as score from x left join prm using (field, value) group by row_id""")
def fm_scores(spark, d):
    p = spark.sql(f"select field, value, w, array(v1, v2) as v from {_PARAMS}")
    return fm.scores(_parts(spark, d)[1], ["tab", "author_id"], p, 0.25)


@query()
def fm_trained_metrics(spark, d):
    """A factorisation machine trained by minibatches on coded fields, stopped early on the valid split; metrics there."""
    train, valid = _parts(spark, d)
    fields = ["user_id", "item_id"]
    names = [f"{f}_code" for f in fields]
    coded = [shared.cut(features.encode(x, train, fields).select("row_id", "user_id", "label", *names)) for x in (train, valid)]
    trainer = fm.MinibatchFM(names)
    return metrics.ranking_metrics(trainer.predict(trainer.fit(*coded), coded[1]))


@query(f"with {IMP} select row_id, label, coalesce(n, 0) as n from valid left join pop using (item_id)")
def label_blind_feature(spark, d):
    """A feature plug-in that never sees the labels of the rows it transforms."""
    train, valid = _parts(spark, d)
    op = models.FrequencyOp("item_id")
    op.fit(train)
    return models.transform_without_label(op, valid).select("row_id", "label", "n")


@query(f"""with {IMP}, v as (select item_id, row_number() over (order by min(row_id), item_id) - 1 as code from train group by item_id)
select row_id, split, case when split <> 'test' then label end as label, coalesce(v.code, (select count(*) from v)) as item_id_code from imp left join v using (item_id)""")
def masked_split_codes(spark, d):
    """All splits coded by the train vocabulary; labels of the hidden split are null."""
    imp = impressions.hide_labels(_imp(spark, d))
    return features.encode(imp, imp.where("split = 'train'"), ["item_id"]).select("row_id", "split", "label", "item_id_code")


@query(f"with {IMP} select row_id, cast(user_id as varchar) as user_id, item_id as video_id, cast(format('{{:.6g}}', score) as double) as score from scored")
def submission_round_trip(spark, d):
    """Scores written as a submission and read back checked."""
    path = f"{shared.shared_folder(spark)}/submission-{uuid.uuid4().hex}"
    predictions.write_submission(_scored(spark, d)[0].withColumnRenamed("item_id", "video_id"), path)
    return predictions.read_submission(spark, path)


# ledgers: both engines read the same literals


def _values(spark, rows: str, names: str, select: str = "*"):
    return spark.sql(f"select {select} from (values {rows}) as t({names})")


_RUNS = "('GAUC', 0.660e0), ('GAUC', 0.662e0), ('GAUC', 0.661e0), ('GAUC', 0.659e0), ('nDCG', 0.530e0), ('nDCG', 0.534e0), ('nDCG', 0.529e0), ('nDCG', 0.531e0), ('few', 0.5e0)"


@query(f"select metric, avg(value) as mean, stddev_samp(value) as sd, max(value) - min(value) as spread, count(*) as n, 2 * sqrt(2e0) * stddev_samp(value) as band from (values {_RUNS}) t(metric, value) group by metric having count(*) >= 3")
def noise_bands(spark, d):
    return ledger.noise_bands(_values(spark, _RUNS, "metric, value"))


_TIMES = "('a', 10e0), ('a', 14e0), ('b', 7e0), ('b', 8e0), ('b', 30e0), ('c', 21e0)"


@query(f"with t as (select * from (values {_TIMES}) t(card, seconds)) select card, median(seconds) / (select median(seconds) from t) as multiplier from t group by card")
def time_multiplier(spark, d):
    return ledger.time_multiplier(_values(spark, _TIMES, "card, seconds"))


_CARDS = "('c1', 's1,s2', 0.5e0, 1), ('c2', 's2', 0.6e0, 2), ('c3', 's3', 0.4e0, 3), ('c4', 's1,s3', 0.5e0, 4), ('c5', 's9', 0.9e0, 5)"
_FOUND = "('s1', 0.7e0), ('s2', 0.4e0), ('s3', cast(null as double))"
_SYMPTOMS = "('s1', true), ('s2', true), ('s4', true), ('s5', false)"


def _cards(spark):
    return _values(spark, _CARDS, "id, treats, prior, ord", "id, split(treats, ',') as treats, prior, ord")


@query(f"""with c as (select id, prior, ord, unnest(string_split(treats, ',')) as symptom from (values {_CARDS}) t(id, treats, prior, ord)), f as (select * from (values {_FOUND}) t(symptom, severity))
select id, sum(coalesce(severity, 1e0)) as severity, prior from c join f using (symptom) group by id, prior, ord order by severity desc, prior desc, ord limit 5""")
def card_match(spark, d):
    return ledger.card_match(_cards(spark), _values(spark, _FOUND, "symptom, severity"))


@query(f"""with c as (select id, prior, ord, unnest(string_split(treats, ',')) as symptom from (values {_CARDS}) t(id, treats, prior, ord) where id not in (select id from (values {_CARDS}) t(id, treats, prior, ord) where ord % 4 = 1)), f as (select * from (values {_FOUND}) t(symptom, severity))
select id, sum(coalesce(severity, 1e0)) as severity, prior from c join f using (symptom) group by id, prior, ord order by severity desc, prior desc, ord limit 5""")
def card_match_excluding(spark, d):
    """Cards that were applied or blocked are left out."""
    return ledger.card_match(_cards(spark), _values(spark, _FOUND, "symptom, severity"), exclude=_cards(spark).where("ord % 4 = 1"))


@query(f"select id from (values {_SYMPTOMS}) t(id, treatable) where treatable and id not in (select unnest(string_split(treats, ',')) from (values {_CARDS}) t(id, treats, prior, ord))")
def uncovered_symptoms(spark, d):
    return ledger.uncovered(_values(spark, _SYMPTOMS, "id, treatable"), _cards(spark))


_PROPOSALS = "('p1', 0.01e0, 0.5e0, 1e0, 1.0e0), ('p2', 0.02e0, 0.4e0, 2e0, 0.05e0), ('p3', -0.01e0, 0.9e0, 1e0, 1e0)"


@query(f"select id, score, row_number() over (order by score desc, id) as place from (select id, greatest(gain, 0e0) * prior / (difficulty * greatest(0.1e0, mult)) as score from (values {_PROPOSALS}) t(id, gain, prior, difficulty, mult))")
def scheduler_topk(spark, d):
    return ledger.schedule(_values(spark, _PROPOSALS, "id, gain, prior, difficulty, multiplier"))


_USAGE = "('diagnose', 'm1', 1000, 200), ('diagnose', 'm2', 500, 100), ('propose', 'm1', 700, 300)"
_PRICES = "('m1', 2e0, 8e0), ('m2', 0.5e0, 1e0)"


@query(f"""select role, u.model, cast(sum(i) as bigint) as tokens_in, cast(sum(o) as bigint) as tokens_out, sum((i * pi + o * po) / 1e6) as cost
from (values {_USAGE}) u(role, model, i, o) left join (values {_PRICES}) p(model, pi, po) on u.model = p.model group by grouping sets ((role), (u.model), ())""")
def token_grouping_sets(spark, d):
    return ledger.token_totals(_values(spark, _USAGE, "role, model, tokens_in, tokens_out"), _values(spark, _PRICES, "model, price_in, price_out"))


_TRUST = "('a', 1, 0.15e0, 0.9e0), ('a', 2, -0.10e0, 0.9e0), ('a', 3, 0.05e0, 0.9e0), ('b', 1, -0.15e0, 0.1e0), ('b', 2, 0.15e0, 0.1e0)"


@query(f"""with recursive t as (select * from (values {_TRUST}) t(card, seq, delta, prior)), f as (
    select card, seq, greatest(0.05e0, least(0.95e0, prior + delta)) as p from t where seq = 1
    union all select t.card, t.seq, greatest(0.05e0, least(0.95e0, f.p + t.delta)) from f join t on t.card = f.card and t.seq = f.seq + 1)
select card, arg_max(p, seq) as prior from f group by card""")
def trust_fold(spark, d):
    return ledger.trust(_values(spark, _TRUST, "card, seq, delta, prior"))


_ROUNDS = "('s', 1, 0.60e0), ('s', 2, 0.6004e0), ('s', 3, 0.61e0), ('s', 4, 0.6101e0), ('s', 5, 0.58e0), ('t', 1, 0.5e0)"


@query(f"""with recursive r as (select * from (values {_ROUNDS}) t(session, round, score)), f as (
    select session, round, score as best, round as best_round, 0 as stale, score as last from r where round = 1
    union all select r.session, r.round, case when r.score > best + 0.001e0 then r.score else best end, case when r.score > best + 0.001e0 then r.round else best_round end, case when r.score > best + 0.001e0 then 0 else stale + 1 end, r.score
    from f join r on r.session = f.session and r.round = f.round + 1)
select session, best, best_round, stale, stale >= 2 as stop, last < best - 0.02e0 as rollback from f qualify row_number() over (partition by session order by round desc) = 1""")
def convergence_fold(spark, d):
    return ledger.convergence(_values(spark, _ROUNDS, "session, round, score"), 0.001, 2, 0.02)


_EPOCHS = "('r', 1, 0.5e0), ('r', 2, 0.6e0), ('r', 3, 0.59e0), ('r', 4, 0.6e0), ('r', 5, 0.9e0), ('q', 1, 0.1e0)"


@query(f"""with recursive t as (select * from (values {_EPOCHS}) t(run, epoch, value)), f as (
    select run, epoch, value as best, epoch as at_epoch, 0 as bad, cast(null as integer) as stop from t where epoch = 1
    union all select t.run, t.epoch, case when stop is null and value > best then value else best end, case when stop is null and value > best then t.epoch else at_epoch end,
        case when value > best then 0 else bad + 1 end, case when stop is not null then stop when value <= best and bad + 1 >= 2 then t.epoch end
    from f join t on t.run = f.run and t.epoch = f.epoch + 1)
select run, at_epoch as best_epoch, stop as stop_epoch from f qualify row_number() over (partition by run order by epoch desc) = 1""")
def early_stopping_fold(spark, d):
    return ledger.early_stopping(_values(spark, _EPOCHS, "run, epoch, value"), 2, 0.0)


@query(f"select run as parameter, avg(value) as value from (values {_EPOCHS}) t(run, epoch, value) where epoch >= 3 group by run")
def swa_average(spark, d):
    return ledger.swa(_values(spark, _EPOCHS, "run, epoch, value", "run as parameter, epoch, value"), 5, 0.75)


_SHELF = "(1, 'c1', 'a'), (2, 'c1', 'a'), (3, 'c1', 'b'), (4, 'c2', 'a'), (5, 'c3', 'a'), (6, 'c4', 'a'), (7, 'c5', 'a'), (2, 'c2', 'a')"


@query(f"select max(round) as round, card, targets from (values {_SHELF}) t(round, card, targets) group by card, targets order by 1 desc, card limit 5")
def shelf_latest(spark, d):
    return ledger.shelf(_values(spark, _SHELF, "round, card, targets"))


_DIGESTS = "('s', 1, true, 11), ('s', 2, false, 0), ('s', 3, true, 11), ('s', 4, true, 12), ('s', 5, false, 0), ('s', 6, false, 0)"


@query(f"""with t as (select * from (values {_DIGESTS}) t(session, round, ok, digest)), l as (select *, last_value(case when ok then digest end ignore nulls) over (partition by session order by round rows between unbounded preceding and 1 preceding) as b from t)
select session, round, case when not ok then 'failed' when b is null then 'first' when b = digest then 'no effect' else 'changed' end as verdict from l""")
def effect_verdict(spark, d):
    return ledger.effect_verdict(_values(spark, _DIGESTS, "session, round, ok, digest"))


@query(f"""with t as (select *, sum(ok::int) over (partition by session order by round) as g from (values {_DIGESTS}) t(session, round, ok, digest))
select session, round, cast(sum((not ok)::int) over (partition by session, g order by round) as bigint) as failures from t""")
def failure_streaks(spark, d):
    return ledger.streaks(_values(spark, _DIGESTS, "session, round, ok, digest"))


_GAINS = "('GAUC', 'dev', 0, 0.60e0), ('GAUC', 'dev', 4, 0.61e0), ('GAUC', 'holdout', 0, 0.59e0), ('GAUC', 'holdout', 4, 0.594e0)"


@query(f"""with g as (select metric, part, arg_max(value, round) - arg_min(value, round) as gain from (values {_GAINS}) t(metric, part, round, value) group by all)
select metric, max(gain) filter (where part = 'dev') as dev_gain, max(gain) filter (where part = 'holdout') as holdout_gain, max(gain) filter (where part = 'dev') - max(gain) filter (where part = 'holdout') as luck from g group by metric""")
def holdout_luck(spark, d):
    return ledger.holdout_luck(_values(spark, _GAINS, "metric, part, round, value"))


_DELTAS = "('r1', 'GAUC', 0.004e0), ('r1', 'nDCG', 0.0001e0), ('r2', 'GAUC', 0.0004e0), ('r3', 'other', 0.0006e0)"


@query(f"""with b as (select metric, 2 * sqrt(2e0) * stddev_samp(value) as band from (values {_RUNS}) t(metric, value) group by metric having count(*) >= 3)
select run, bool_or(abs(gain) >= greatest(0.0005e0, coalesce(band, 0))) as beats from (values {_DELTAS}) t(run, metric, gain) left join b using (metric) group by run""")
def beats_noise(spark, d):
    return ledger.beats_noise(_values(spark, _DELTAS, "run, metric, gain"), ledger.noise_bands(_values(spark, _RUNS, "metric, value")))


_PATCHES = "('a.b', '1', 1, true), ('a.b', '2', 2, true), ('a.c', 'x', 1, true), ('a.b', '9', 3, false), ('d', 'q', 4, true)"


@query(f"select path, arg_max(value, seq) as value from (values {_PATCHES}) t(path, value, seq, ok) where ok group by path")
def patch_merge(spark, d):
    return ledger.patch_merge(_values(spark, _PATCHES, "path, value, seq, ok"))


@query(f"with {IMP}, l as (select 'x' as run, date, avg(label) as score from imp group by date) select run, bool_and(coalesce(d, true)) and count(*) > 1 as falls from (select run, lag(score) over (order by date) > score as d from l) group by run")
def monotone_by_date(spark, d):
    per = _imp(spark, d).groupBy("date").agg(F.avg("label").alias("score")).withColumn("run", F.lit("x"))
    return ledger.monotone_fall(per)


_TEXTS = "('epochs', 'lr=0.1 in epochs_x'), ('lr', 'lr=0.1'), ('none', 'nothing')"


@query(f"select k, regexp_matches(t, '(^|[^A-Za-z0-9_])' || k || '($|[^A-Za-z0-9_])') as word, regexp_matches(t, '[0-9]') as evidence, length(t) as width from (values {_TEXTS}) x(k, t)")
def text_rules(spark, d):
    rows = _values(spark, _TEXTS, "k, t")
    word = F.coalesce(*[F.when(F.col("k") == k, tx.whole_word(F.col("t"), k)) for k in ("epochs", "lr", "none")])
    return rows.select("k", word.alias("word"), tx.has_evidence(F.col("t"), F.array(F.lit("「」"))).alias("evidence"), tx.display_width(F.col("t")).cast("long").alias("width"))


@query("select event_type as kind, string_agg(cast(event_id as varchar) || ';', '' order by event_id) as text from events group by event_type")
def event_stream_text(spark, d):
    """The event log read as a stream into a table, then joined to one text per kind."""
    base = f"{shared.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    src = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("text"))
    ledgers.append_jsonl(src.repartition(3, "seq"), f"{base}/log")
    live.drain(live.tail(spark, f"{base}/log", "kind string, seq long, text string"), f"{base}/table", f"{base}/checkpoint")
    return live.assemble_text(spark.read.parquet(f"{base}/table"))


@query(f"""with t as (select event_type as kind, string_agg(cast(event_id as varchar) || ';', '' order by event_id) as text from events group by event_type)
select kind, chunk, substring(text, chunk * {live.CHUNK} + 1, {live.CHUNK}) as text from (select kind, text, unnest(range(0, (length(text) + {live.CHUNK - 1}) // {live.CHUNK})) as chunk from t)""")
def event_stream_chunks(spark, d):
    """The event log written in three parts, each read as a batch of a stateful stream, as one text per kind in chunks."""
    base = f"{shared.shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    src = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("text"))
    least, most = src.agg(F.min("seq"), F.max("seq")).first()
    for k in range(3):
        part = src.where((F.col("seq") - least) * 3 >= k * (most - least + 1)).where((F.col("seq") - least) * 3 < (k + 1) * (most - least + 1))
        ledgers.append_jsonl(part, f"{base}/log")
        live.drain_chunks(live.tail(spark, f"{base}/log", "kind string, seq long, text string", 1_000), f"{base}/table", f"{base}/checkpoint")
    return live.latest_chunks(spark, f"{base}/table").select("kind", "chunk", "text")


@query(f"""with e as (select event_type as kind, event_id as seq, cast(event_id as varchar) || ';' as text, (select quantile_disc(event_id, 0.25) from events) as a, (select quantile_disc(event_id, 0.75) from events) as b from events),
t as (select kind, string_agg(text, '' order by seq) as text from e where seq >= a and seq < b group by kind)
select kind, chunk, substring(text, chunk * {live.CHUNK} + 1, {live.CHUNK}) as text from (select kind, text, unnest(range(0, (length(text) + {live.CHUNK - 1}) // {live.CHUNK})) as chunk from t)""")
def event_range_chunks(spark, d):
    """The text of each kind between two offsets of the event log, in chunks."""
    src = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("text"))
    a, b = src.select(F.percentile("seq", F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    return live.chunks_between(src, int(a), int(b))


@query("select row_number() over (order by event_id) - 1 as row_id, cast(event_id as varchar) as event_id, event_type || chr(10) || '\"' || cast(user_id as varchar) || '\",' || chr(10) as note from events")
def csv_rows_in_file_order(spark, d):
    """Events written as CSV files with line breaks in quotes and read back; row_id is the place in the files."""
    folder = f"{shared.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id"), F.concat("event_type", F.lit('\n"'), F.col("user_id").cast("string"), F.lit('",\n')).alias("note"))
    rows.orderBy("event_id").write.options(header=True, escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    return ordered.read_csv(spark, folder)

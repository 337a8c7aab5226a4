"""The queries of the ten operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.llm import chat, decontaminate, embeddings, jaccard, kneser_ney, maintext, manifest, packing, periods, quality, substrings, urls, warc
from impressa.llm.shared import remainder

#: The tokenizer file of op2 and op7, read on the driver.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard.classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_chat_formatting(spark, sf_dir):
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.windows(turns, tokenizer=TOKENIZER))


def op3_url_filters(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_suffix_array_dedup(spark, sf_dir):
    return substrings.digests(_table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_packing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.token_lengths(docs, TOKENIZER), length=F.col("length"))


def op8_lm_scoring(spark, sf_dir):
    return kneser_ney.score(_table(spark, sf_dir, "documents"), order=3, prune=0)


def op9_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op10_quality_classifier(spark, sf_dir):
    scored = quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op11_html_extraction(spark, sf_dir):
    return maintext.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_periodic_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", periods.with_periodic_tail("text", F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    return periods.digests(periods.detect(planted))


def op13_merkle_manifest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = manifest.leaf(*(F.replace(c, F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in fields))
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    made = manifest.manifest(docs, fields, tampered=F.when(even & F.contains("text", F.lit("\n")), tampered))
    folded = made.withColumn("folded_root", manifest.fold(F.col("path"), F.coalesce("tampered", "leaf")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_chat_formatting, op3_url_filters, op4_embedding_near_dedup, op5_suffix_array_dedup,
    op6_warc, op7_packing, op8_lm_scoring, op9_benchmark_decontamination, op10_quality_classifier,
    op11_html_extraction, op12_periodic_runs, op13_merkle_manifest)}

#: CRC-32 of a text of one-byte characters, bit by bit; 3988292384 is its reversed polynomial.
_CRC32 = """xor(list_reduce(list_transform(string_split({text}, ''), lambda s: cast(ascii(s) as bigint)),
    lambda c, b: list_reduce(range(0, 8), lambda k, z: xor(k >> 1, 3988292384 * (k & 1)), xor(c, b)), cast(4294967295 as bigint)), 4294967295)"""


def _leaf_sql(*values: str) -> str:
    """Digest of a row: each value - if null, else its byte count, a colon and the value."""
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(cast({v} as varchar))) || ':' || cast({v} as varchar), '-')" for v in values) + ")"


_COMPONENTS = """
    walk(node, reach) as (
        select node, node from nodes
        union
        select w.node, e.b from walk w join edges e on w.reach = e.a
    )"""

ORACLE = {
    "op1_ngram_jaccard_join": f"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words
), items as materialized (select doc_id, len(s) as n, hash(unnest(s)) as t from sets
), common as materialized (select x.doc_id as a, y.doc_id as b, x.n as na, y.n as nb, count(*) as c from items x join items y on x.t = y.t and x.doc_id <> y.doc_id group by all
), edges as materialized (select a, b from common where 100 * c >= 75 * (na + nb - c)
), nodes as (select doc_id as node from sets), {_COMPONENTS}
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, cast(r.c as bigint) as component_id
from sets s join (select node, min(reach) as c from walk group by node) r on r.node = s.doc_id""",
    "op4_embedding_near_dedup": f"""
with recursive good as materialized (
    select vec_id, cast(embedding as double[]) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), edges as materialized (
    select x.vec_id as a, y.vec_id as b from good x join good y on x.vec_id <> y.vec_id and len(x.v) = len(y.v) where list_cosine_similarity(x.v, y.v) >= 0.95
), nodes as (select vec_id as node from embeddings), {_COMPONENTS}, c as (select node, min(reach) as c from walk group by node)
select vec_id, (select count(*) from edges where a = vec_id) as n_links, c.c as component_id, vec_id = c.c as kept from embeddings join c on c.node = vec_id""",
    "op5_suffix_array_dedup": """
with raw as (
    select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), spots as materialized (
    select doc_id, i, hash(substring(h, 2 * i + 1, 100)) as k from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as i from raw)
), first as (select k, min(doc_id) as d from spots group by k
), hits as (select spots.doc_id, i from spots join first using (k) where first.d < spots.doc_id
), runs as (
    select doc_id, min(i) as s, max(i) + 50 as e from (
        select doc_id, i, sum(new) over (partition by doc_id order by i) as g from (
            select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as new from hits))
    group by doc_id, g
), kept as (
    select doc_id, sum(e - s) as removed, count(*) as n, list(s order by s) as ss, list(e order by s) as es from runs group by doc_id
)
select raw.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(n, 0) as bigint) as n_spans,
    sha256(unhex(case when n is null then h else array_to_string(list_transform(range(0, n + 1), lambda j:
        substring(h, cast(case when j = 0 then 0 else 2 * es[j] end as bigint) + 1, cast((case when j = n then len(h) else 2 * ss[j + 1] end) - (case when j = 0 then 0 else 2 * es[j] end) as bigint))), '') end)) as kept_sha256
from raw left join kept using (doc_id)""",
    "op6_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages
), d as (select page_id, octet_length(b) as n, sha1(b) as h from p
), t as (select *, max(page_id) over (partition by h, n) as first from d)
select page_id, cast(n as bigint) as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
        (((strpos('0123456789abcdef', substring(h || '00', 1 + (5 * i) // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substring(h || '00', 2 + (5 * i) // 4, 1)) - 1) >> cast(3 - (5 * i) % 4 as integer)) & 31 as integer), 1)), '') as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from t""",
    "op9_benchmark_decontamination": """
with d as materialized (
    select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), b as (
    select item_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), bw as materialized (
    select distinct id, n, array_to_string(w[i:i + n - 1], ' ') as t from (select id, w, least(13, len(w)) as n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)
), dw as (
    select id, n, i, array_to_string(w[i:i + n - 1], ' ') as t from (select d.id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw))
), hit as materialized (select dw.id, dw.i, dw.n, bw.id as item from dw join bw on dw.n = bw.n and dw.t = bw.t
), words as (select id, count(distinct x) as n_hit from (select id, unnest(range(i, i + n)) as x from hit) group by id
), items as (select id, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct id, cast(item as varchar) as item from hit) group by id)
select d.id as doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items,
    sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (id) left join items using (id)""",
    # for the form that the pages of the table have: one article element of headings and paragraphs, with the references of escaped text
    "op11_html_extraction": """
with a as (select page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?(?:p|h1)>') as parts from pages
), t as (
    select page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(?:x27|39);?', chr(39), 'g'), '&amp;?', '&', 'g'),
        '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from a
)
select page_id, url, text, cast(length(text) as bigint) as n_chars from t""",
    "op12_periodic_runs": f"""
with h as (
    select doc_id, {_CRC32.format(text="cast(doc_id as varchar)")} as h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), g as (select *, len(w) as n, (h // 10) % greatest(len(w), 1) as a, 3 + (h // 10) % 8 as parts from h
), texts as materialized (
    select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // parts) end]) else w end as w from g
), words as materialized (select doc_id, n, unnest(range(0, n)) as i, unnest(w) as w from texts
), equal as (
    select x.doc_id, y.i - x.i as p, x.i from words x join words y on x.doc_id = y.doc_id and x.w = y.w and x.i < y.i where y.i - x.i <= x.n // 2
), stretches as (
    select doc_id, p, min(i) as s, count(*) + p as length from (select doc_id, p, i, i - row_number() over (partition by doc_id, p order by i) as k from equal) group by doc_id, p, k
), runs as materialized (
    select doc_id, s, length, min(p) as p from stretches where length >= greatest(12, 2 * p) group by doc_id, s, length
), told as (
    select doc_id, count(*) as n_runs, string_agg(s || ',' || length || ',' || p || chr(10), '' order by s, p) as lines, first(struct_pack(s := s, length := length, p := p) order by length desc, s, p) as best from runs group by doc_id
), gone as (select distinct w.doc_id, w.i from words w join runs r on r.doc_id = w.doc_id and w.i >= r.s + r.p and w.i < r.s + r.length
), kept as (select w.doc_id, string_agg(w.w, ' ' order by w.i) as t from words w anti join gone using (doc_id, i) group by w.doc_id)
select doc_id, coalesce(n_runs, 0) as n_runs, cast(best.s as bigint) as start, cast(best.length as bigint) as length, cast(best.p as bigint) as period, cast(1000 * best.length // best.p as bigint) as exponent_milli,
    sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from texts left join told using (doc_id) left join kept using (doc_id)""",
    "op13_merkle_manifest": f"""
with recursive d as materialized (
    select doc_id, case when source is null then '' else '+' || source end as key, {_leaf_sql("doc_id", "source", "lang", "n_chars", "text")} as leaf,
        case when {_CRC32.format(text="cast(doc_id as varchar)")} % 2 = 0 then {_leaf_sql("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")} end as other from documents
), placed as materialized (select *, row_number() over w - 1 as p, count(*) over (partition by key) as n from d window w as (partition by key order by doc_id nulls first, leaf)
), up as (
    select key, 0 as k, p, n, leaf as h from placed
    union all
    select key, k + 1, p // 3, max((n + 2) // 3), sha256(string_agg(h, '' order by p)) from up where n > 1 group by key, k, p // 3
), made as materialized (select * from up
), tops as materialized (select key, h as subroot, row_number() over (order by key) - 1 as p, count(*) over () as n from made where n = 1
), up2 as (
    select 0 as k, p, n, subroot as h from tops
    union all
    select k + 1, p // 3, max((n + 2) // 3), sha256(string_agg(h, '' order by p)) from up2 where n > 1 group by k, p // 3
), made2 as materialized (select * from up2
), beside as materialized (
    select key, k, p, coalesce(lag(h, 2) over w, '') || coalesce(lag(h) over w, '') as l, coalesce(lead(h) over w, '') || coalesce(lead(h, 2) over w, '') as r
    from made where n > 1 window w as (partition by key, k, p // 3 order by p)
), beside2 as materialized (
    select k, p, coalesce(lag(h, 2) over w, '') || coalesce(lag(h) over w, '') as l, coalesce(lead(h) over w, '') || coalesce(lead(h, 2) over w, '') as r
    from made2 where n > 1 window w as (partition by k, p // 3 order by p)
), steps as materialized (
    select key, d.p, k, l, r from placed d join beside b using (key) where b.p = d.p // cast(pow(3, b.k) as bigint)
    union all
    select d.key, d.p, 1000 + k, l, r from placed d join tops t using (key) join beside2 b on b.p = t.p // cast(pow(3, b.k) as bigint)
), numbered as materialized (select key, p, l, r, row_number() over (partition by key, p order by k) as i, count(*) over (partition by key, p) as m from steps
), proofs as (select key, p, string_agg(l || r, '' order by i) as proof from numbered group by key, p
), fold as (
    select key, p, coalesce(other, leaf) as h, 0 as i from placed
    union all
    select f.key, f.p, sha256(s.l || f.h || s.r), s.i from fold f join numbered s on s.key = f.key and s.p = f.p and s.i = f.i + 1
), folded as (select key, p, max_by(h, i) as folded_root from fold group by key, p)
select doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) as proof_sha256, folded_root, folded_root = root as verified
from placed join (select key, subroot from tops) using (key) join folded using (key, p) left join proofs using (key, p) cross join (select h as root from made2 where n = 1)""",
}

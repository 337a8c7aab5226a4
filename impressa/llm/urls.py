"""URL filters: listed host/path rules, then association rules mined by FP-growth.

The listed rules judge first.  Urls without a rule are judged by association
rules over url tokens (host labels, path segments, scheme, query keys): Spark's
FP-growth mines token combinations of labelled urls, those that imply a label
with enough support and confidence are kept, and an inverted index (token to
rule) finds the rules whose tokens all occur in a url.  The matching rule of
highest confidence, then support, decides; without any, ``allow``.

All work is DataFrame operations.  A null url, or one without ``://``, has an
empty host and path; tokens are distinct per url; repeated urls are judged
alike; labels with a null verdict are ignored; no labelled urls give no mined
rules; ties of confidence go to the larger support, then to the larger rule,
then to the rule's number; further columns, whatever their names, are not read;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from impressa.llm.shared import cut, spread_join

#: (host, path, verdict): fixed values of the list.
LISTED = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules=LISTED) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null.

    A rule fits its host and all subdomains if the path starts with its path.
    """
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in order]
    return F.coalesce(*fits)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels and suffixes, path segments, extension, query keys.  Numbers become ``#``."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    top = F.array(F.concat(F.lit("t:"), F.substring_index(host, ".", -1)), F.concat(F.lit("d:"), F.substring_index(host, ".", -2)))
    parts = F.filter(F.split(F.regexp_replace(path, r"\d+", "#"), "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.concat(top, segments, keys, labels))


def rule_tokens(rules=LISTED) -> list[str]:
    """The tokens that hosts and paths of the rules give: labels that come from the rules follow from them alone."""
    out = set()
    for host, path, _ in rules:
        labels = [x for x in host.split(".") if x]
        out |= {f"t:{labels[-1]}", f"d:{'.'.join(labels[-2:])}", *(f"h:{x}" for x in labels), *(f"p:{x}" for x in path.split("/") if x)}
    return sorted(out)


def token_groups(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(token, item, n): the tokens with min_support, and for those that occur in the same labelled urls one that stands for all.

    At most (mean number of tokens of a url) / min_support rows.
    """
    least = F.ceil(F.lit(min_support * labelled.count()))
    each = labelled.groupBy("items").agg(F.count(F.lit(1)).alias("n")).select("n", F.xxhash64("items").alias("a"), F.xxhash64("items", F.lit("again")).alias("b"), F.explode("items").alias("token"))
    known = each.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("n") >= least)
    return known.select("token", F.min("token").over(Window.partitionBy("a", "b", "n")).alias("item"), "n")


def mine(labelled: DataFrame, groups: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, items, verdict, confidence, support, size) from rows of (items, verdict); items are those of ``groups``.

    FP-growth counts in Spark, over all tokens with min_support (no frequent set
    holds another) and without a bound on the size of a rule.  Tokens that only
    occur together count as one item: a rule with several of them has the same
    confidence as a rule with one, and would go.  A rule needs min_support of
    the labelled rows and min_confidence, and goes if a subset of its items
    implies the same label with at least its confidence.
    """
    total = labelled.count()
    spark = labelled.sparkSession
    if not total:
        return spark.createDataFrame([], "rule_id long, items array<string>, verdict string, confidence double, support double, size int")
    # equal rows of a partition become one row with a number, which is spread again where FP-growth counts
    counted = labelled.groupBy("items", "verdict", F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    reduced = labelled.select("items").distinct().select("items", F.explode("items").alias("token")).join(F.broadcast(groups), "token").groupBy("items").agg(F.collect_set("item").alias("kept"))
    rows = counted.join(reduced, "items").select(F.concat("kept", F.array(F.concat(F.lit("label="), "verdict"))).alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k")).select("items")
    sets = cut(FPGrowth(minSupport=min_support, minConfidence=min_confidence).fit(rows).freqItemsets)
    is_label = F.exists("items", lambda x: x.startswith("label="))
    body = F.array_sort(F.filter("items", lambda x: ~x.startswith("label=")))
    bodies = sets.where(~is_label).select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
    heads = sets.where(is_label & (F.size("items") > 1)).select(body.alias("items"), F.expr("substring(filter(items, x -> startswith(x, 'label='))[0], 7)").alias("verdict"), "freq")
    rules = heads.join(bodies, "items").select("items", "verdict", (F.col("freq") / F.col("n")).alias("confidence"), (F.col("freq") / total).alias("support"), F.size("items").alias("size"))
    rules = rules.where(F.col("confidence") >= min_confidence).withColumn("rule_id", F.xxhash64("items", "verdict"))
    # redundant: one item fewer implies the same label at least as surely
    less = rules.where("size > 1").select("rule_id", "verdict", "confidence", F.explode(F.expr("transform(items, x -> array_remove(items, x))")).alias("items"))
    weaker = less.alias("a").join(rules.alias("b"), (F.col("a.items") == F.col("b.items")) & (F.col("a.verdict") == F.col("b.verdict")) & (F.col("a.confidence") <= F.col("b.confidence"))).select(F.col("a.rule_id").alias("gone"))
    return rules.join(weaker.distinct(), F.col("rule_id") == F.col("gone"), "left_anti").select("rule_id", "items", "verdict", "confidence", "support", "size")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", listed=LISTED, labelled: DataFrame | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per page: page_id, host, path, rule (listed, else null), verdict, mined_rule, confidence.

    ``labelled`` (url, verdict) are the labels to mine; by default the urls that
    the list decides, without the tokens that the list itself reads.  Urls with equal items are matched once.  The inverted
    index has a rule under its rarest item; the rules found there are checked
    for their other items.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("items", tokens(F.col("url"), F.col("host"), F.col("path"))).withColumn("r", listed_rule(F.col("host"), F.col("path"), listed))
    if labelled is None:
        # else mining would only find the list again, and hold pages without a rule for what the rules' hosts and paths say
        rows = rows.withColumn("items", F.array_except("items", F.array(*map(F.lit, rule_tokens(listed)))))
        known = rows.where("r is not null").select("items", F.col("r.verdict").alias("verdict"))
    else:
        own = labelled.select("url", "verdict").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "url", "verdict")
        known = own.select(tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"), "verdict")
    known = known.where("verdict is not null")
    groups = cut(token_groups(known, min_support))
    rules = cut(mine(known, groups, min_support, min_confidence))
    often = groups.groupBy("item").agg(F.max("n").alias("n"))
    index = rules.select("rule_id", "items", "verdict", "confidence", "support", "size", F.explode("items").alias("item")).join(F.broadcast(often), "item")
    index = index.groupBy("rule_id").agg(F.min_by("item", F.struct("n", "item")).alias("item"), F.first("items").alias("needs"), *[F.first(c).alias(c) for c in ("verdict", "confidence", "support", "size")])
    # only items of some rule count, so urls shrink to few distinct sets
    used = groups.join(F.broadcast(rules.select(F.explode("items").alias("item")).distinct()), "item", "left_semi").select("token", "item")
    open_rows = rows.where("r is null and url is not null").select("url", "items").distinct()
    sets = cut(open_rows.select("url", F.explode("items").alias("token")).join(F.broadcast(used), "token").groupBy("url").agg(F.array_sort(F.collect_set("item")).alias("items")))
    hits = sets.select("items").distinct().select("items", F.explode("items").alias("item")).join(index, "item").where(F.size(F.array_except("needs", "items")) == 0)
    best = hits.groupBy("items").agg(F.max_by(F.struct("verdict", "rule_id", "confidence"), F.struct("confidence", "support", "size", "rule_id")).alias("_m"))
    found = spread_join(sets, best, "items", F.col("url")).select(F.col("url").alias("_url"), "_m")
    rows = rows.join(found, F.col("url") == F.col("_url"), "left").withColumn("m", F.when(F.col("r").isNull(), F.col("_m")))
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "m.verdict", F.lit("allow")).alias("verdict"), F.col("m.rule_id").alias("mined_rule"), F.col("m.confidence").alias("confidence"))


def listed_rules(spark: SparkSession, rules=LISTED) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")

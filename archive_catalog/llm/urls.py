"""URL filtering by fixed prefix rules and by association rules mined with FP-growth.

A URL becomes a set of tokens (host labels by place, path words, query keys). Labelled URLs add an item for their verdict; FP-growth
finds frequent token combinations, and those rules whose consequence is a verdict are kept if their support and confidence suffice and no shorter rule of the same verdict is
as confident. Confidence suffices if it is ``min_confidence`` or more and if the verdict is likelier under the rule than among all labelled URLs by more than chance: the lower bound of
its Wilson interval at ``Z`` standard deviations must be above the verdict's base rate. So labels that have nothing to do with URLs yield no rules. Mined rules match by an inverted index: each rule is listed under its rarest
token, distinct URLs look their tokens up there, and the rest of the rule is then checked in the URL's own token set. Fixed rules go first.

Defined results: a null URL or one without "://" has empty host and path, no tokens and the verdict ``allow``; repeated URLs
are judged once and joined back to every row; empty labels mine no rules; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Verdict, host, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "verdict="
Z = 2.58


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule; null if none fits."""
    out = None
    for verdict, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        hit = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(url: Column) -> Column:
    """Distinct tokens: the host, its labels, path words, the query's keys and the scheme."""
    host, path = host_of(url), path_of(url)
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.rlike(r"^\d+$")), lambda x: F.concat(F.lit("p:"), x))
    query = F.transform(F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"([^&=]+)="), 1), lambda x: F.concat(F.lit("q:"), x))
    return F.coalesce(F.array_distinct(F.flatten(F.array(labels, words, query, F.array(F.concat(F.lit("site:"), host))))), F.array().cast("array<string>"))


def wilson_low(share: Column, n: Column, z: float = Z) -> Column:
    """Lower end of the interval of a share that was seen in n cases."""
    return (share + z * z / (n * 2) - z * F.sqrt(share * (F.lit(1.0) - share) / n + z * z / (n * n * 4))) / (F.lit(1.0) + z * z / n)


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, least: int = 5) -> DataFrame:
    """Rules (rule_id, items, verdict, confidence, support) from rows (url, verdict); ``least``: URLs that hold a rule and its verdict."""
    baskets = labelled.where(F.col("url").isNotNull() & F.col("verdict").isNotNull()).select(F.array_union(tokens_of(F.col("url")), F.array(F.concat(F.lit(MARK), "verdict"))).alias("items"))
    total = baskets.count()
    # FP-growth counts equal baskets, so its trees grow with distinct combinations
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, least / max(1, total))), minConfidence=min_confidence).fit(baskets)
    found = (
        model.associationRules.where(F.col("consequent")[0].startswith(MARK))
        .where(wilson_low(F.col("confidence"), F.col("support") * total / F.col("confidence")) > F.col("confidence") / F.col("lift"))
        .select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], len(MARK) + 1, 1000).alias("verdict"), "confidence", "support")
    )
    rules = written(found.withColumn("rule_id", F.xxhash64(F.array_join("items", "\x01"), "verdict")), "url-rules")
    # a rule is pruned if leaving out one item loses no confidence
    shorter = (
        rules.where(F.size("items") > 1)
        .select("rule_id", "verdict", F.col("confidence").alias("own"), F.explode(F.transform("items", lambda x: F.array_except("items", F.array(x)))).alias("items"))
        .join(rules.select("items", "verdict", "confidence"), ["items", "verdict"])
        .where(F.col("confidence") >= F.col("own"))
        .select("rule_id").distinct()
    )
    return rules.join(shorter, "rule_id", "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict, confidence) for those of the distinct ``urls`` that a rule fits; the most confident rule wins, block on a tie."""
    tokens = urls.select("url", tokens_of(F.col("url")).alias("tokens"))
    words = rules.select("rule_id", F.explode("items").alias("item"))
    weight = words.groupBy("item").agg(F.count("*").alias("n"))
    index = words.join(weight, "item").groupBy("rule_id").agg(F.min_by("item", F.struct("n", "item")).alias("item")).join(rules, "rule_id")
    hits = (
        tokens.select("url", "tokens", F.explode("tokens").alias("item"))
        .join(index.select("item", "items", "verdict", "confidence"), "item")
        .where(F.size(F.array_except("items", "tokens")) == 0)
    )
    best = F.max(F.struct("confidence", (F.col("verdict") == "block").alias("blocks"), "verdict"))
    return hits.groupBy("url").agg(best.alias("best")).select("url", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, default: str = "allow", key: str = "page_id", url: str = "url", **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of a mined rule) for every row of ``pages``."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    mined = match(rows.where(F.col("url").isNotNull()).select("url").distinct(), mine(labelled, **mining))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    fixed = fixed_rule(host, path, rules)
    return rows.join(mined, "url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), fixed["rule"].alias("rule"),
        F.coalesce(fixed["verdict"], "mined", F.lit(default)).alias("verdict"), F.when(fixed.isNull(), F.col("confidence")).alias("confidence"),
    )


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the documents with the pages' ids: low quality or toxic means block."""
    from .shared import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    labelled = pages.join(labels, pages.page_id == labels.doc_id).select("url", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("verdict"))
    return judge(pages, labelled)

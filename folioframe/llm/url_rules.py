"""URL filters: stated rules first, then association rules mined by FP-growth.

A url is a set of tokens (host labels, path segments, query names). Spark's
FP-growth mines token sets of labelled pages together with the item "bad".
The thresholds come from the data: a rule that implies "bad" is kept when the
lower Wilson bound of its confidence, from the pages that it was seen on, is
above ``lift`` times the share of bad pages and above ``confidence``, and when
no part of it is a rule at least as sure. Rules are pruned and matched by an
inverted index on each rule's rarest token: rules and the urls' distinct token
sets meet only what is filed under one of their tokens. DataFrame and Spark ML
operations only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, materialise, pick, table

#: Stated rules: host, path prefix, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
BAD = "label:bad"
#: Most blocked token sets to broadcast, some 100 bytes each; beyond it only hot ones.
BROADCAST_SETS = 100_000
#: Most tokens of all rules together to broadcast; beyond it only rules under hot tokens.
BROADCAST_TOKENS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path; both empty where the url is null or has no ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pick(pages, "page_id", "url").select(
        "page_id",
        "url",
        F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"),
    )


def stated(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest stated rule that fits host (or a domain above it) and path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """The distinct tokens of a url; numbers become ``0``."""
    numberless = lambda parts: F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), "0").otherwise(p))
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(tag), p))
    low = F.lower(F.coalesce(F.col("url"), F.lit("")))
    query = F.split(F.regexp_extract(low, r"\?([^#]*)", 1), "&")
    names = F.transform(query, lambda q: F.substring_index(q, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(tagged("h:", F.split("host", "[.]")), tagged("p:", numberless(F.split(F.lower("path"), "[/._-]"))), tagged("q:", names))))


def filed(rules: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One row for each token that rules are filed under: token and rules (rule_id, needs, sure).

    A rule is filed under the token that fewest of ``seen`` (token, n) hold, by default fewest rules.
    """
    posted = rules.select("rule_id", F.col("items").alias("needs"), "sure", F.explode("items").alias("token"))
    counts = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")) if seen is None else seen
    counted = posted.join(counts, "token", "left")
    one = counted.groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"), F.first("needs").alias("needs"), F.first("sure").alias("sure"))
    return materialise(one.groupBy("token").agg(F.collect_list(F.struct("rule_id", "needs", "sure")).alias("rules")), "url-index")


def met(sets: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``sets`` (items and others) once for each rule r of the index whose tokens they all hold."""
    tokens_held = index.agg(F.coalesce(F.sum(F.aggregate("rules", F.lit(0), lambda n, r: n + F.size(r["needs"]))), F.lit(0))).first()[0]
    posted = sets.withColumn("token", F.explode("items"))
    joined = join_unique(posted, index, ["token"], rows=BROADCAST_TOKENS if tokens_held <= BROADCAST_TOKENS else 0)
    return joined.withColumn("r", F.explode("rules")).filter(F.size(F.array_except("r.needs", "items")) == 0).drop("token", "rules")


def mine(labelled: DataFrame, support: float, least_pages: int, confidence: float, lift: float, z: float = 2.0) -> DataFrame:
    """Rules (rule_id, items, confidence, support, sure) that imply a bad page; ``sure`` is the lower bound that decides.

    ``labelled`` has the columns items and bad. All labelled pages are mined.
    """
    rows = materialise(labelled.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"), "bad"), "url-labelled")
    n, bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    none = F.lit(None)
    empty = rows.filter(F.lit(False)).select(none.cast("long").alias("rule_id"), "items", *(none.cast("double").alias(c) for c in ("confidence", "support", "sure")))
    if not bad or bad == n:
        return empty
    least = max(confidence, lift * bad / n)
    if least > 1:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least_pages / n)), minConfidence=least).fit(rows.select("items"))
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    times = F.col("support") * n / F.col("confidence")  # pages that hold the rule's tokens
    share, spread = F.col("confidence"), F.lit(z * z) / times
    sure = (share + spread / 2 - F.sqrt(spread * share * (1 - share) + spread * spread / 4)) / (1 + spread)
    found = found.select(F.array_sort("antecedent").alias("items"), "confidence", "support", sure.alias("sure")).filter(F.col("sure") > least)
    found = materialise(found.withColumn("rule_id", F.xxhash64("items")), "url-rules")
    # pruned: a rule goes if one of its parts is a rule at least as sure
    parts = met(found.select("rule_id", "items", "sure"), filed(found)).filter((F.size("r.needs") < F.size("items")) & (F.col("r.sure") >= F.col("sure")))
    return found.join(parts.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", "items", "confidence", "support", "sure")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, support: float = 0.002, least_pages: int = 20, confidence: float = 0.5, lift: float = 1.5) -> DataFrame:
    """page_id, url, host, path, rule, verdict and mined (ids of the mined rules that match) of every page.

    A page is bad for the miner when its label, joined by page_id = doc_id,
    says toxic or of no quality. Null urls have empty host and path, no
    tokens and the verdict allow; a url of any length is judged whole;
    repeated rows get equal verdicts; of rules that tie all are listed, and of
    stated rules of one length the last in order wins; several labels of one
    page say bad if one does; without usable labels there are no mined rules;
    columns that aren't named here are not looked at whatever their names; an
    empty table gives no rows.
    """
    urls = split_url(pages).withColumn("items", tokens())
    marks = pick(labels, "doc_id", "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))
    learned = materialise(mine(urls.join(marks, urls["page_id"] == marks["doc_id"]).select("items", "bad"), support, least_pages, confidence, lift), "url-mined")
    sets = materialise(urls.select("items").distinct().withColumn("set_id", F.xxhash64("items")), "url-sets")
    seen = sets.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    matched = met(sets, filed(learned, seen))
    blocked = materialise(matched.groupBy("set_id").agg(F.array_sort(F.collect_set("r.rule_id")).alias("mined")), "url-blocked")
    rule, verdict = stated(rules)
    judged = join_unique(urls.withColumn("set_id", F.xxhash64("items")), blocked, ["set_id"], "left", rows=BROADCAST_SETS)
    by_method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "mined")


def op3_mined_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.coalesce(F.size("mined"), F.lit(0)).alias("n_mined"))

"""URL filter: fixed host and path rules, then association rules mined from labelled URLs.

A URL is a set of tokens (host, its suffixes, path segments with numbers
folded, file extension, query keys). FP-growth mines token combinations over
the labelled URLs, each transaction carrying its label as one more token;
rules that conclude a label are kept by support and confidence, and a rule is
dropped when a part of its tokens concludes the same with at least its confidence. A rule is
filed under its rarest token, and a URL meets the rules filed under its
tokens; one whose tokens it holds all applies. The rule of highest confidence
decides, block on a tie; without one the URL is allowed.

A fixed rule fits its host and all subdomains if the path starts with the
rule's path; the longest that fits wins and stands above the mined ones. Null
urls and urls without :// have empty host and path and no tokens, hence no rule, and are
allowed. Unlabelled data mines no rules. Repeated pages give repeated rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

# Fixed values: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]

_LABEL = "label="


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url; runs of digits are folded to 0 so that ids don't make tokens of their own."""
    fold = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, -i, i), ".")))
    parts = F.transform(F.array_remove(F.split(fold(path), "/"), ""), lambda s: F.concat(F.lit("path="), s))
    words = F.transform(F.split(host, r"[.\-]"), lambda s: F.concat(F.lit("word="), s))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.array_remove(F.split(query, "&"), ""), lambda s: F.concat(F.lit("key="), F.substring_index(s, "=", 1)))
    every = F.array_distinct(F.concat(suffixes, words, parts, keys))
    return F.when(F.length(host) > 0, every).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6) -> DataFrame:
    """(need array, verdict, confidence, support) from rows of (tokens, verdict)."""
    baskets = labelled.filter(F.size("tokens") > 0).select(F.array_append("tokens", F.concat(F.lit(_LABEL), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.select("antecedent", F.element_at("consequent", 1).alias("then"), "confidence", "support")
    rules = rules.filter(F.col("then").startswith(_LABEL)).select(
        F.array_sort("antecedent").alias("need"), F.substring("then", len(_LABEL) + 1, 100).alias("verdict"), "confidence", "support")
    rules = cut(rules, "url-rules")
    # a rule goes if dropping one of its tokens leaves a rule of the same verdict with no less confidence
    parts = rules.withColumn("drop", F.explode("need")).select(
        "need", "verdict", "confidence", F.array_except("need", F.array("drop")).alias("part"))
    shorter = rules.select(F.col("need").alias("n2"), F.col("verdict").alias("v2"), F.col("confidence").alias("c2"))
    beaten = parts.join(shorter, F.expr("part = n2 and verdict = v2 and c2 >= confidence")).select("need", "verdict").distinct()
    return rules.join(beaten, ["need", "verdict"], "left_anti")


def apply_mined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined, confidence) for every distinct url of (url, tokens) that a rule fits."""
    rules = cut(rules, "url-kept")
    each = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    wanted = rules.select(F.explode("need").alias("token")).distinct()
    often = each.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = (rules.withColumn("token", F.explode("need")).join(often, "token")
             .groupBy("need", "verdict", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token")))
    met = each.join(cut(filed, "url-index"), "token").filter(F.size(F.array_except("need", "tokens")) == 0)
    best = F.max(F.struct("confidence", F.col("verdict").alias("mined")))
    return met.groupBy("url").agg(best.alias("b")).select("url", "b.mined", "b.confidence")


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of `pages`: page_id, host, path, rule, verdict, mined (the method's verdict), confidence.

    `labels`: (doc_id, quality, toxic) of pages; quality 0 or toxic 1 counts as block.
    """
    host, path = host_path(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    base = base.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    said = (labels.filter("doc_id is not null").groupBy("doc_id")
            .agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")))
    labelled = base.join(said, F.col("page_id") == F.col("doc_id")).select(
        "tokens", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("verdict"))
    urls = base.filter("url is not null").select("url", "tokens").dropDuplicates(["url"])
    mined = cut(apply_mined(urls, mine(labelled)).withColumnRenamed("url", "murl"), "url-mined")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    return (base.join(mined, F.col("url") == F.col("murl"), "left").withColumns({"rule": rule, "fixed": verdict})
            .select("page_id", "host", "path", "rule", F.coalesce("fixed", "mined", F.lit("allow")).alias("verdict"), "mined", "confidence"))

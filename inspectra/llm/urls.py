"""URL filters: stated rules first, association rules mined from labelled pages for the rest. DataFrame functions only.

Mining: every labelled page is a basket of its URL's tokens and, for bad ones, the item `=bad`. Spark's FP-growth finds
frequent combinations; those that imply `=bad` with enough confidence and support stay, unless a rule on fewer of the
same tokens is as confident. Matching: distinct token sets meet the rules through an index from each rule's token to the
rule, and a rule matches where all its tokens are found. Verdicts go back to the pages by URL.

Defined cases: a null URL, or one without ://, has empty host and path, no tokens and the verdict allow; no labels, or
no rule that passes, gives allow; repeated rows and URLs are judged alike; an empty table gives an empty table; other
columns of the input are kept, result columns replace those of the same name, no other name is taken. A basket's tokens
are those of one URL, so itemsets are as long as a URL has tokens at most.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, lower_ascii, unused

#: (verdict, host and path) of the stated rules.
STATED = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, BAD = 0.002, 0.7, "=bad"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: h:<label> of the host, p:<word> of the path (split at / . - _), d:<number of path segments>."""
    labels = F.transform(F.filter(F.split(host, r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(F.lower(path), r"[/._\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    depth = F.concat(F.lit("d:"), F.size(F.filter(F.split(path, "/"), lambda x: x != "")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(labels, parts, F.array(depth))))


def stated_rule(host: Column, path: Column, rules=STATED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest stated rule that fits host and path; nulls where none does."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def mine_rules(baskets: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rule_id, tokens, confidence, support, from baskets (items: distinct tokens, with BAD in those of bad pages).

    A rule is dropped if one on a part of its tokens is at least as confident. The pair check runs on the rules that
    passed, through the tokens that they share.
    """
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0] == BAD)
    ready = keep(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").withColumn("rule_id", F.xxhash64("tokens")), "url-rules")
    each = ready.select("rule_id", "confidence", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    wide = each.alias("a").join(each.alias("b"), "token").where("a.n < b.n and a.confidence >= b.confidence")
    covered = wide.groupBy("a.rule_id", "b.rule_id", "a.n").agg(F.count(F.lit(1)).alias("shared")).where("shared = n").select("b.rule_id").distinct()
    return ready.join(covered, "rule_id", "left_anti")


def match_rules(urls: DataFrame, key: str, tokens: str, rules: DataFrame) -> DataFrame:
    """key of the rows of urls for which all tokens of some rule are present, with the best confidence."""
    index = rules.select("rule_id", "confidence", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    hits = urls.select(key, F.explode(tokens).alias("token")).join(index, "token")
    whole = hits.groupBy(key, "rule_id", "n", "confidence").agg(F.count(F.lit(1)).alias("found")).where("found = n")
    return whole.groupBy(key).agg(F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, url: str = "url", page_id: str = "page_id", rules=STATED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """pages with host, path, rule and verdict. labels: page_id and bad (boolean); null or missing labels teach nothing."""
    names = ("host", "path", "rule", "verdict")
    host, path = url_host(F.col(url)), url_path(F.col(url))
    known = labels.where("bad is not null").groupBy(F.col("page_id").alias("id")).agg(F.max("bad").alias("bad"))
    taught = pages.select(F.col(page_id).alias("id"), url_tokens(host, path).alias("tokens")).where(F.size("tokens") > 0).join(known, "id")
    baskets = taught.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    mined = keep(mine_rules(baskets, min_support, min_confidence), "url-mined")
    distinct = pages.select(F.col(url).alias("url")).where("url is not null").distinct()
    met, said_mined = unused(pages, "met_url"), unused(pages, "mined_verdict")
    matched = match_rules(distinct.withColumn("tokens", url_tokens(url_host(F.col("url")), url_path(F.col("url")))), "url", "tokens", mined)
    rule, said = stated_rule(host, path, rules)
    out = pages.join(matched.select(F.col("url").alias(met), F.lit("block").alias(said_mined)), F.col(url) == F.col(met), "left")
    verdict = F.coalesce(said, F.col(said_mined), F.lit("allow"))
    return out.select(*[c for c in pages.columns if c.lower() not in names], host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"))

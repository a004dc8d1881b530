"""URL filtering by host-suffix and path-prefix expressions.

A URL is expanded into every host suffix and path prefix that some rule could
have; each expression's SHA-256 is joined to the rules' on its first four bytes,
and the full digest confirms the match.  The longest matching rule decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many rules are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 1_000_000
#: Hexadecimal digits of a digest that the join compares.
PREFIX_DIGITS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host, path; both are empty where the url is null or has no ://."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id"),
        F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url).

    rules: host, path, verdict (allow or block).  A rule fits its host and the
    subdomains of it where the url's path starts with the rule's path.  Of the
    rules that fit, the one with the longest text decides; of equally long ones,
    that with the longer host, then block before allow.  Where none fits, rule is
    null and the verdict is `otherwise`.  A rule with a null host or verdict fits
    nothing; a null path is an empty one.  Repeated rows are judged alike, each
    url once; null page_ids are kept.  Other columns are ignored.
    """
    rules = rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(
        F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    # What is gathered here is bounded by the longest rule: the lengths that occur.
    shape = rules.agg(
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths"), F.count(F.lit(1)).alias("n")
    ).head()
    parts = split_url(pages)
    if not shape["n"]:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    labels, lengths = (F.array(*map(F.lit, sorted(shape[k]))) for k in ("labels", "lengths"))

    urls = parts.select("host", "path").distinct()
    count = F.size(F.split("host", r"\."))
    suffix = F.explode(F.filter(labels, lambda n: n <= count))
    exprs = urls.withColumn("n", suffix).withColumn("length", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))))
    exprs = exprs.select("host", "path", F.expr("concat(array_join(slice(split(host, '[.]'), -n, n), '.'), left(path, length))").alias("expression"))
    exprs = exprs.withColumn("digest", F.sha2("expression", 256))

    text = F.concat("rule_host", "rule_path")
    known = rules.select(F.sha2(text, 256).alias("rule_digest"), text.alias("rule"), F.length("rule_host").alias("host_length"), "rule_verdict")
    known = known.groupBy("rule_digest", "rule", "host_length").agg(F.max("rule_verdict").alias("rule_verdict"))
    if shape["n"] <= BROADCAST_RULES:
        known = F.broadcast(known)
    same_prefix = F.substring("digest", 1, PREFIX_DIGITS) == F.substring("rule_digest", 1, PREFIX_DIGITS)
    hits = exprs.join(known, same_prefix).where("digest = rule_digest")
    best = F.max(F.struct(F.length("rule").alias("length"), "host_length", "rule_verdict", "rule")).alias("best")
    judged = hits.groupBy("host", "path").agg(best)
    out = parts.join(judged, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(otherwise)).alias("verdict"))

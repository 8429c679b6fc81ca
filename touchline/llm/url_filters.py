"""Operator 2: URL filters by host-suffix and path-prefix expressions (DataFrame functions only).

A rule (host, path) fits a URL if the URL's host is the rule's host or below it and its path starts with the rule's
path. Each distinct (host, path head) pair is expanded into the expressions ``host suffix + path prefix`` that some
rule could have, the pair is equi-joined with the rules on the first 4 bytes of the SHA-256 digest, candidates are
confirmed by the full digest, and the longest confirmed rule wins.

Scale: URLs are reduced to distinct (host, path head) pairs before the join, so a host with a third of all URLs joins
once for each of its path heads; the join back to the URLs is an equi-join that adaptive execution splits where one
pair is hot. Expansion is bounded by the rules' own label counts and path lengths, never by the URL.

Defined results: a null URL or one without ``://`` has empty host and path and fits no rule; a URL without a path has
an empty one, which fits only rules with an empty path. Repeated rows and repeated ids stay, row for row. Of equally
long rules the one with the longer host wins; of the same rule given twice, ``block`` wins.
No rules: every URL gets the default verdict. Only the id and URL columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: Rules of the registered query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hashed_rules(rules: DataFrame) -> DataFrame:
    """The rule list as it is joined: short prefix, full digest, rule, verdict; one row a rule."""
    rule = F.concat(F.translate("host", UPPER, LOWER), "path")
    one = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    full = _digest(F.concat_ws("\n", "host", "path"))
    return one.select(_short(full).alias("short"), full.alias("digest"), rule.alias("rule"), F.length("host").alias("host_len"), "verdict")


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``urls``; ``rules`` has host, path, verdict."""
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])
    head = max(lengths, default=0)
    pages = urls.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).withColumn("head", F.substring("path", 1, head))
    keys = pages.filter(F.col("host") != "").select("host", "head").distinct()
    depth = F.length("host") - F.length(F.translate("host", ".", "")) + 1
    suffixes = F.filter(F.array(*[F.when(depth >= k, F.substring_index("host", ".", -k)) for k in labels]), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length("head") >= n, F.substring("head", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    if not labels:
        return pages.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    expressions = keys.select("host", "head", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "head", "suffix", F.explode("prefixes").alias("prefix"))
    full = _digest(F.concat_ws("\n", "suffix", "prefix"))
    hits = expressions.select("host", "head", full.alias("digest"), _short(full).alias("short")).join(hashed_rules(rules).withColumnRenamed("digest", "rule_digest"), "short").filter(F.col("digest") == F.col("rule_digest"))
    best = hits.groupBy("host", "head").agg(F.max(F.struct(F.length("rule").alias("n"), "host_len", "rule", "verdict")).alias("best"))
    best = written(best, "url-rules")  # a plain table on the right lets Spark split a hot pair's URLs in the join
    return pages.join(best, ["host", "head"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS r(host, path, verdict)")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP2_SQL = r"""
WITH r(host, rpath, verdict) AS (VALUES ('com','/','allow'),('example.com','/en/','block'),('www.example.com','/en/','allow'),('net','/es/','block'),('net','/fr/','block')),
p AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS n FROM pages),
m AS (SELECT n, r.host || r.rpath AS rule, r.verdict,
  row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.rpath) DESC, length(r.host) DESC, r.host) AS k
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)
"""

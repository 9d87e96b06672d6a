"""URL filters: a sort-merge range join of reversed-host canonical keys with rule intervals (DataFrame operations only).

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's path. Its key is
the reversed host, a slash and the path; all keys that start with it make an interval, and intervals of prefixes nest.
A url stands in the sorted order once for each suffix of its host that is no longer than the longest rule host.
Rules and urls are dealt out by ranges of the key, sorted, and swept: the last rule that began at or before a url is the top
of the stack, and the stack below it is that rule's own chain of enclosing rules, which is built once from the
rules. A range begins with the rule that was the top of the stack when the range before it ended, so that no range
depends on another's rows. The longest rule (host and path together, then host) decides.

Null urls and those without "://" have an empty host and path and fit no rule of a non-empty host. Rules with a null host
or path, or a slash, ? or # in the host, can fit nothing and are ignored; of equal rules, block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def reversed_key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path)


def rule_chains(rules: DataFrame) -> DataFrame:
    """(key, chain): each rule's key with itself and all rules around it, the innermost last."""
    r = rules.where("host is not null and path is not null and not host rlike '[/?#]'").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    r = r.select(reversed_key(F.split("host", r"\."), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_len"))
    inner = r.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("outer"))
    entry = F.struct(F.length("outer").alias("n"), F.col("outer"), "rule", "verdict", "host_len").alias("entry")
    outer = r.withColumnRenamed("key", "outer").select("outer", entry)
    return inner.join(outer, "outer").groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("chain"))


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """Distinct (host, path) of the urls with rule (null where none fits) and verdict."""
    spark = urls.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    host, path = host_and_path(F.col(url))
    distinct = urls.select(host.alias("host"), path.alias("path")).distinct()
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(1, deepest)))), lambda k: F.slice(labels, n - k + 1, k))
    points = distinct.select("host", "path", F.explode(suffixes).alias("labels")).select(reversed_key(F.col("labels"), F.col("path")).alias("key"), F.lit(1).alias("is_url"), "host", "path")
    chains = rule_chains(rules).withColumn("is_url", F.lit(0))
    both = points.unionByName(chains, allowMissingColumns=True)
    # written, as the borders of the ranges come from a sample and both uses below must see the same ones
    dealt = written(both.repartitionByRange(partitions, "key").withColumn("part", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("part").agg(F.max_by("chain", F.when(F.col("is_url") == 0, F.col("key"))).alias("chain"))  # a row for each range
    carried = ends.select("part", F.last("chain", ignorenulls=True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("chain"))
    swept = dealt.unionByName(carried.select("part", "chain", F.lit("").alias("key"), F.lit(0).alias("is_url")), allowMissingColumns=True)
    top = F.last("chain", ignorenulls=True).over(W.partitionBy("part").orderBy("key", "is_url").rowsBetween(W.unboundedPreceding, 0))
    swept = swept.withColumn("stack", top).where("is_url = 1")
    hits = F.filter("stack", lambda e: F.col("key").startswith(e["outer"]))
    best = F.when(F.size(hits) > 0, F.element_at(hits, -1))
    found = swept.select("host", "path", best.alias("e")).select("host", "path", F.when(F.col("e").isNotNull(), F.struct(F.length("e.rule").alias("n"), F.col("e.host_len").alias("h"), F.col("e.rule").alias("rule"), F.col("e.verdict").alias("verdict"))).alias("e"))
    out = found.groupBy("host", "path").agg(F.max("e").alias("e"))
    return out.select("host", "path", F.col("e.rule").alias("rule"), F.coalesce("e.verdict", F.lit(default)).alias("verdict"))


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """The rows with host, path, rule and verdict; columns of these names that were there before are replaced."""
    host, path = host_and_path(F.col(url))
    rows = df.drop("rule", "verdict").withColumn("host", host).withColumn("path", path) if url not in ("host", "path") else df.select(url, host.alias("host"), path.alias("path"))
    return rows.join(judge_urls(df, rules, url, default, partitions), ["host", "path"], "left")

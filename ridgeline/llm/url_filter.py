"""URL rules by a sort-merge range join.

A rule (host, path, verdict) fits its host and every subdomain when the url's path starts with the
rule's. Reversing a host's labels and appending the path gives a canonical key under which the urls of
one rule host form the interval [key, key + 0xFF). A url is probed once for each host suffix it has.
Probes and interval ends are sorted together; a sweep along the order counts the intervals that are
open. Prefix intervals are nested or disjoint, so the open ones form a stack: its top at a url with
depth d is the last interval whose start brought the depth to d.

Defined results: null or ``://``-less urls have empty host and path, so no rule; an url without a rule
gets the default verdict; of equally long rules the one with the longer host wins, and of repeated rules
that disagree, block. An empty rule or page table gives rows without rules, or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sweep takes about so many probes; a rule host with more is dealt over as many sweeps, each with all its rules.
SWEEP = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    host = F.when(url.contains("://"), F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    path = F.when(url.contains("://"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
    return F.coalesce(path, F.lit(""))


def canonical_key(host: Column, path: Column) -> Column:
    """Binary, so that 0xFF sorts after every text with the same prefix."""
    turned = F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")
    return F.concat(turned, F.lit("\x00"), path).cast("binary")


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", sweep_rows: int = SWEEP) -> DataFrame:
    """pages with host, path, rule and verdict. rules: host, path, verdict."""
    pages = pages.drop("rule", "verdict").withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rules = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.min(F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("rank"))
        .select("host", "path", F.when(F.col("rank") == 0, "block").otherwise("allow").alias("verdict"))
    )
    labels = F.split("host", r"\.", -1)
    probes = (
        pages.select("host", "path")
        .where(F.col("host") != "")
        .distinct()
        .withColumn("labels", labels)
        .withColumn("level", F.explode(F.sequence(F.lit(1), F.size("labels"))))
        .withColumn("suffix", F.array_join(F.slice("labels", F.col("level"), F.size("labels")), "."))
        .select("suffix", "host", "path")
    )
    # sweeps by the number of probes, so that a host which holds most urls is many tasks and any other is one
    own = rules.select(F.col("host").alias("suffix")).distinct()
    counted = probes.join(own, "suffix", "left_semi").groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    sweeps = counted.select("suffix", F.ceil(F.col("n") / F.lit(sweep_rows)).cast("int").alias("sweeps"))
    probes = (
        probes.join(sweeps, "suffix")
        .select(
            "suffix",
            F.pmod(F.xxhash64("host", "path"), F.col("sweeps")).cast("int").alias("salt"),
            canonical_key(F.col("suffix"), F.col("path")).alias("key"),
            F.lit(1).alias("kind"),
            F.lit(0).alias("step"),
            F.struct("host", "path").alias("page"),
            F.lit(None).cast("struct<rule:string,host_length:int,verdict:string>").alias("rule"),
        )
    )
    key = canonical_key(F.col("host"), F.col("path"))
    ends = F.array(
        F.struct(key.alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step")),
        F.struct(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step")),
    )
    body = F.struct(F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict")
    bounds = (
        rules.select("host", body.alias("body"), F.explode(ends).alias("end"))
        .join(sweeps.withColumnRenamed("suffix", "host"), "host")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)))
        .select(
            F.col("host").alias("suffix"),
            "salt",
            "end.key",
            "end.kind",
            "end.step",
            F.lit(None).cast("struct<host:string,path:string>").alias("page"),
            F.when(F.col("end.kind") == 0, F.col("body")).alias("rule"),
        )
    )
    sweep = Window.partitionBy("suffix", "salt").orderBy("key", "kind")
    level = Window.partitionBy("suffix", "salt", "depth").orderBy("key", "kind")
    to_here = (Window.unboundedPreceding, Window.currentRow)
    top = (
        probes.unionByName(bounds)
        .withColumn("depth", F.sum("step").over(sweep.rowsBetween(*to_here)))
        .withColumn("top", F.last("rule", ignorenulls=True).over(level.rowsBetween(*to_here)))
        .where((F.col("kind") == 1) & (F.col("depth") > 0))
    )
    best = top.groupBy("page").agg(
        F.max(F.struct(F.length("top.rule").alias("length"), F.col("top.host_length").alias("host_length"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))).alias("best")
    )
    best = best.select(F.col("page.host").alias("host"), F.col("page.path").alias("path"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return pages.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))

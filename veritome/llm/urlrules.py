"""URL filtering by a sort-merge range join with nested prefix rules.

A rule (host, path, verdict) fits a url if the url's host is the rule's or ends with a dot and the rule's, and its path
starts with the rule's.  Under the canonical key, the labels of the host in reverse order, a rule is an interval of paths: from its path up to its path with a byte FF,
which no UTF-8 text has.  Intervals of one key nest.

One sorted sweep goes over the ends of the intervals and the urls: an opening end adds one to the depth of the stack, a closing end takes one off.  As intervals nest, the top of a stack of depth d
is the rule whose opening end was the last to reach depth d, so the stack is kept as that end for each depth, not as an array: the sweep is two window functions, a running sum and a last value.
Both go over ranges of the sort order, which sampling cuts to equal sizes within keys too: the depth at a range's start is the sum of the ranges before it, and what was open at each depth
there is the last end that reached it.  So neither a host with most rules nor one with most urls is one task; equal keys and paths are told apart by a hash of the host.

Urls meet a key for every suffix of their host that has rules; the longest rule (host and path) wins, by its text if there are several of that length.
Of rules with the same host and path, block wins.  Equal urls are judged once and joined back: those that make up more than a HOTth of all rows, so fewer than HOT, by a broadcast, the others by
a shuffle, in which rows that are done, or have no host, are spread out.

A rule is the product of an interval of reversed hosts and an interval of paths, which isn't an interval of the two together unless its path is empty; so hosts are looked up level by level, and the
sweep with its stack is over the paths of each level.

All of it is DataFrame operations.  Cases: a null url, or one without ://, has an empty host and path, which no rule fits; rules with a null host or path fit nothing; a repeated row gets its
own row; further columns are ignored; an empty table of rules leaves every url to the default; empty pages give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.llm.oracles import LOWER, UPPER
from veritome.llm.runtime import durable

HOT = 1000
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def swept(ends: DataFrame, urls: DataFrame) -> DataFrame:
    """ends (key, at, opens, rule), at as bytes, opens true or false and rule null where it closes, and urls (key, at, spread, of) -> (of, rule), the innermost open rule of each url that has one."""
    kind = F.when(F.col("opens"), 1).otherwise(0)
    events = ends.select("key", "at", kind.alias("kind"), F.lit(0).cast("long").alias("spread"), F.when(F.col("opens"), 1).otherwise(-1).alias("step"), "rule", F.lit(None).cast(urls.schema["of"].dataType).alias("of"))
    events = events.unionByName(urls.select("key", "at", F.lit(2).alias("kind"), "spread", F.lit(0).alias("step"), F.lit(None).cast(ends.schema["rule"].dataType).alias("rule"), "of"))
    order = ["at", "kind", "spread"]
    ranged = durable(events.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()))
    before = lambda *keys: W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    within = lambda *keys: W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)

    starts = ranged.groupBy("key", "part").agg(F.sum("step").alias("sum")).select("key", "part", F.coalesce(F.sum("sum").over(before("key")), F.lit(0)).alias("start"))
    deep = ranged.join(starts, ["key", "part"]).withColumn("depth", F.col("start") + F.sum("step").over(within("key", "part"))).where("depth > 0 AND kind > 0")
    lasts = deep.groupBy("key", "depth", "part").agg(F.max_by("rule", F.when(F.col("kind") == 1, F.col("at"))).alias("last"))
    carried = lasts.select("key", "depth", "part", F.last("last", ignorenulls=True).over(before("key", "depth")).alias("carried"))
    top = deep.withColumn("top", F.last("rule", ignorenulls=True).over(within("key", "part", "depth"))).where("kind = 2")
    return top.join(carried, ["key", "depth", "part"]).select("of", F.coalesce("top", "carried").alias("rule"))


def judged(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages."""
    rows = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    named = rules.select(reversed_host(F.col("host")).alias("key"), F.encode("path", "utf-8").alias("low"), F.struct(F.concat("host", "path").alias("rule"), "verdict").alias("rule"))
    both = F.array(F.struct(F.col("low").alias("at"), F.lit(True).alias("opens")), F.struct(F.concat("low", F.lit(b"\xff")).alias("at"), F.lit(False).alias("opens")))
    ends = named.select("key", "rule", F.inline(both)).withColumn("rule", F.when(F.col("opens"), F.col("rule")))

    levels = rows.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("times")).withColumn("labels", F.reverse(F.split("host", r"\.")))
    levels = levels.select("host", "path", "times", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", F.lit(1), k), "."))).alias("key"))
    levels = levels.join(named.select("key").distinct(), "key", "left_semi")
    met = swept(ends, levels.select("key", F.encode("path", "utf-8").alias("at"), F.xxhash64("host").alias("spread"), F.struct("host", "path", "times").alias("of")))
    best = F.max(F.struct(F.length("rule.rule").alias("n"), F.col("rule.rule").alias("rule"), F.col("rule.verdict").alias("verdict")))
    best = durable(met.groupBy("of.host", "of.path", "of.times").agg(best.alias("best")))
    often = F.col("times") * HOT > rows.count()
    hot = best.where(often).select("host", "path", F.col("best").alias("hot"))
    spread = F.concat(F.lit("//"), F.xxhash64("page_id", "path").cast("string"))  # which no host is
    asked = rows.join(F.broadcast(hot), ["host", "path"], "left").withColumn("by", F.when(F.col("hot").isNull() & (F.col("host") != ""), F.col("host")).otherwise(spread))
    out = asked.join(best.where(~often).select(F.col("host").alias("by"), "path", "best"), ["by", "path"], "left").withColumn("best", F.coalesce("hot", "best"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_rules(spark, sf_dir):
    from veritome.llm.runtime import table

    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES))))
    return judged(table(spark, sf_dir, "pages"), rules)

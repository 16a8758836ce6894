"""Resolution of not-modified revisits in web archives.

A revisit record says that a url had not changed; its content and most headers are those of an earlier full response.  Each revisit is joined, by canonical
url, as of its time, to the latest full response that is strictly earlier (of several at one time the one with the greatest record id).  Then its validators are checked:
an ETag must equal the response's but for W/; without one, Last-Modified must be equal; a revisit with neither agrees with any.  If they agree, the response's
headers are updated by those of the revisit that a 304 answer may set (PERMITTED); names are compared in lower case.

The as-of join scans in two steps, so that no url's history gathers in one task: the history is cut into slices of time; within a slice a running maximum finds the
response before each revisit, and the last response of each slice is carried into the slices after it.

Cases: a null url is that of no response, and its revisit has the outcome no_response; a null time has no earlier response; null headers are empty; repeated rows are kept; further columns
are ignored; an empty table gives an empty result; payloads are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.llm.oracles import LOWER, UPPER

#: What a 304 answer updates of a stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
SLICE = 86_400


def canonical_url(url: Column) -> Column:
    """Without scheme, www., default ports, fragment, utm_ parameters and a last slash; host in lower case, parameters in order."""
    text = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")
    text = F.regexp_replace(text, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(text, r"(?s)^([^/?]*)", 1), UPPER, LOWER)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(text, r"(?s)^[^/?]*([^?]*)", 1), r"/$", "")
    pairs = F.filter(F.split(F.regexp_extract(text, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_"))
    return F.concat(host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(pairs), "&"))).otherwise(""))


def _entries(headers: str) -> Column:
    return F.coalesce(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))


def _of(entries: Column, name: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(1))["value"]


def resolved(records: DataFrame, *, slice_seconds: int = SLICE) -> DataFrame:
    """records (record_id, url, ts long seconds, kind 'response' or 'revisit', headers map) ->
    one row for each revisit: (record_id, canonical_url, ts, source_id, outcome, headers), outcome being resolved, mismatch or no_response."""
    rows = records.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", _entries("headers").alias("entries"), F.col("url").isNotNull().alias("has_url"))
    rows = rows.where("has_url OR kind = 'revisit'").withColumn("slice", F.floor(F.col("ts") / slice_seconds))
    lost, rows = rows.where("NOT has_url"), rows.where("has_url").drop("has_url")
    response = F.when((F.col("kind") == "response") & F.col("ts").isNotNull(), F.struct("ts", "record_id", "entries"))
    before = W.partitionBy("canonical_url", "slice").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(response).over(before)).where("kind = 'revisit'")
    last = rows.where("kind = 'response' AND ts IS NOT NULL").groupBy("canonical_url", "slice").agg(F.max(F.struct("ts", "record_id", "entries")).alias("last"))
    # every slice that has a record: what was the last response before it?
    slices = last.unionByName(rows.where("kind = 'revisit' AND ts IS NOT NULL").select("canonical_url", "slice").distinct(), allowMissingColumns=True)
    slices = slices.groupBy("canonical_url", "slice").agg(F.max("last").alias("last"))
    carried = slices.withColumn("carried", F.max("last").over(W.partitionBy("canonical_url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))).drop("last")
    joined = near.join(carried, ["canonical_url", "slice"], "left").withColumn("source", F.when(F.col("ts").isNotNull(), F.coalesce("near", "carried")))

    etag, stored = _of(F.col("entries"), "etag"), _of(F.col("source.entries"), "etag")
    bare = lambda tag: F.regexp_replace(tag, r"^W/", "")
    modified = _of(F.col("entries"), "last-modified")
    agrees = F.when(etag.isNotNull(), bare(etag) == F.coalesce(bare(stored), F.lit(""))).when(modified.isNotNull(), modified == F.coalesce(_of(F.col("source.entries"), "last-modified"), F.lit(""))).otherwise(True)
    joined = joined.withColumn("outcome", F.when(F.col("source").isNull(), "no_response").when(agrees, "resolved").otherwise("mismatch"))
    fresh = F.filter("entries", lambda e: e["key"].isin(*PERMITTED))
    old = F.filter("source.entries", lambda e: ~F.exists(fresh, lambda f: f["key"] == e["key"]))
    # names that occur again give their last value
    merged = F.array_sort(F.concat(old, fresh))
    single = F.filter(merged, lambda e, i: F.coalesce(F.get(merged, i + 1)["key"] != e["key"], F.lit(True)))
    headers = F.when(F.col("outcome") == "resolved", F.map_from_entries(single))
    out = joined.select("record_id", "canonical_url", "ts", F.when(F.col("outcome") != "no_response", F.col("source.record_id")).alias("source_id"), "outcome", headers.alias("headers"))
    none = lost.select("record_id", "canonical_url", "ts", F.lit(None).alias("source_id"), F.lit("no_response").alias("outcome"), F.lit(None).alias("headers"))
    return out.unionByName(none.select(*(F.col(c).cast(out.schema[c].dataType).alias(c) for c in out.columns)))


def captures(pages: DataFrame) -> DataFrame:
    """An archive's records made of pages (page_id, url, html), with p for the id and an ETag from the page's MD5.

    4p: the full response at second 1000p. 4p + 1: of every third page another, with an ETag and a Last-Modified of its own, 300,000 s later.
    4p + 2: a revisit 700,000 s after the first, of every seventh page 1 s before it; it states by turns the first response's ETag, weakly, the last one's, the last one's Last-Modified, or nothing.
    4p + 3: a revisit 100,000 s after the first, so before the second, with the first one's ETag.
    """
    p = F.col("page_id")
    ts, twice = p * 1000, p % 3 == 0
    text = lambda *c: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in c))
    tag = F.md5(F.coalesce("html", F.lit("")))
    first, second = text('"', tag, '"'), text('"', tag, '-2"')
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")

    def headers(**fields: Column | str):
        given = [F.struct(F.lit(k.replace("_", "-")).alias("key"), (v if isinstance(v, Column) else F.lit(v)).alias("value")) for k, v in fields.items()]
        return F.map_from_entries(F.filter(F.array(*given), lambda e: e["value"].isNotNull()))

    late = F.when(p % 7 == 0, ts - 1).otherwise(ts + 700_000)
    stated = F.when(p % 4 == 0, text("W/", first)).when(p % 4 == 1, F.when(twice, second).otherwise(first))
    modified = F.when(p % 4 == 2, text(F.when(twice, "n").otherwise("m"), p.cast("string")))
    record = lambda id, at, kind, fields, when=F.lit(True): F.when(when, F.struct((p * 4 + id).alias("record_id"), at.alias("ts"), F.lit(kind).alias("kind"), fields.alias("headers")))
    records = F.array(
        record(0, ts, "response", headers(Content_Type="text/html", Content_Length=size, ETag=first, Last_Modified=text("m", p.cast("string")), Cache_Control="max-age=60")),
        record(1, ts + 300_000, "response", headers(Content_Type="text/html", Content_Length=size, ETag=second, Last_Modified=text("n", p.cast("string")), Cache_Control="max-age=30"), twice),
        record(2, late, "revisit", headers(ETag=stated, Last_Modified=modified, Content_Length="0", Cache_Control="max-age=600", Date=(ts + 700_000).cast("string"))),
        record(3, ts + 100_000, "revisit", headers(ETag=text("W/", first), Content_Length="0", Content_Type="none", Date=(ts + 100_000).cast("string"))),
    )
    return pages.select("url", F.inline(F.filter(records, lambda r: r.isNotNull())))


def op1_revisits(spark, sf_dir):
    from veritome.llm.runtime import table

    found = resolved(captures(table(spark, sf_dir, "pages")))
    header = lambda name: F.try_element_at("headers", F.lit(name))
    return found.select("record_id", "canonical_url", "ts", "source_id", "outcome", F.coalesce(F.size("headers"), F.lit(0)).cast("long").alias("n_headers"), header("content-length").alias("content_length"), header("cache-control").alias("cache_control"), header("date").alias("date"), header("etag").alias("etag"), header("last-modified").alias("last_modified"))

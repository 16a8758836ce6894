"""What the catalogue's queries derive from the given tables: headed lines, ranked lists, claims, requests and scores.

Each has a Spark form here and a DuckDB form in catalog.py, from the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: one page each, with the document's id."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")


def headed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which each line i has a numbered heading before it: a.b, or a.b.r, with a = i // 300 + 1, b = i % 300 // 3 + 1 and r = i % 3."""
    lines = F.split("text", "\n")

    def headed(line, i):
        section = F.concat((F.floor(i / 300) + 1).cast("string"), F.lit("."), (F.floor(i % 300 / 3) + 1).cast("string"))
        number = F.when(i % 3 == 0, section).otherwise(F.concat(section, F.lit("."), (i % 3).cast("string")))
        return F.concat(number, F.lit("  Title "), F.upper(F.regexp_extract(line, r"([A-Za-z]+)", 1)), F.lit("\n"), line)

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.lit(1).alias("page_number"), F.array_join(F.transform(lines, headed), "\n").alias("text"))


def many_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pages of five lines; every second one has a running header on its second page, every third a scope heading on its third."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("page_number", F.floor(F.col("i") / 5).cast("int") + 1)
    rows = lines.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n").alias("text"))
    head = F.when((F.col("doc_id") % 2 == 0) & (F.col("page_number") == 2), F.concat(F.lit("3GPP TS 28."), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit(" version 18.5.0 Release 18\n"))).otherwise("")
    scope = F.when((F.col("doc_id") % 3 == 0) & (F.col("page_number") == 3), "1  Scope\n").otherwise("")
    return rows.select("doc_id", "page_number", F.concat(head, scope, "text").alias("text"))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("-"), "doc_id").alias("spec_id"), F.lit("v1").alias("version"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name for each document, of the four forms in turn."""
    n = F.col("doc_id")
    six = lambda x: F.lpad(x.cast("string"), 6, "0")
    name = F.when(n % 4 == 0, F.concat(F.lit("ts_1"), F.lpad((n % 90000 + 10000).cast("string"), 5, "0"), F.lit("v"), six(n % 1000000), F.lit("p.pdf"))).when(n % 4 == 1, F.concat(F.lit("TR_"), F.lpad((n % 90000 + 10000).cast("string"), 5, "0"), F.lit("_v"), (n % 19).cast("string"), F.lit(".1.0.pdf"))).when(n % 4 == 2, F.concat(F.lit("doc_"), (n % 100000 + 100).cast("string"), F.lit("_r"), (n % 9).cast("string"), F.lit(".pdf"))).otherwise(F.concat(F.lit("notes-"), n.cast("string"), F.lit(".pdf")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a chunk."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("s"), F.col("label"))).otherwise("base").alias("owner"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector asks."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.concat(F.lit("s"), F.col("label")).alias("session"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of every document: all its lines in turn cite it, bare or decorated, the next document, or nothing that exists."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("query_id"), F.posexplode(F.split("text", "\n")).alias("i", "claim"))
    own = F.col("query_id").cast("string")
    cite = F.when(F.col("i") % 4 == 0, own).when(F.col("i") % 4 == 1, F.concat(F.lit("[Source: "), own, F.lit("]"))).when(F.col("i") % 4 == 2, (F.col("query_id") + 1).cast("string")).otherwise(F.concat(F.lit("x"), own))
    return rows.select("query_id", (F.col("i") + 1).alias("n"), "claim", cite.alias("raw_citation")).withColumn("citation", X.citation(F.col("raw_citation")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a generator to every document: JSON as such, in a fence, in prose, without sufficient evidence, and cut off."""
    docs = table(spark, sf_dir, "documents")
    first = F.regexp_extract("text", r"([A-Za-z]+)", 1)
    body = F.concat(F.lit('{"answer": "'), first, F.lit('", "claims": [{"claim": "a) '), first, F.lit(' x", "citation": "'), F.col("doc_id").cast("string"), F.lit('"}, {"claim": "", "citation": "q"}], "sufficient": true}'))
    kind = F.col("doc_id") % 5
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).when(kind == 3, F.lit('{"answer": "INSUFFICIENT_EVIDENCE", "claims": [], "sufficient": true}')).otherwise(F.concat(F.lit('{"answer": "'), first))
    return docs.select(F.col("doc_id").alias("query_id"), raw.alias("raw"))


def whole_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like responses, with the whole text as the answer and each of its lines as a claim, JSON-escaped."""
    own = F.col("doc_id").cast("string")
    claims = F.transform(F.split("text", "\n"), lambda line: F.struct(F.concat(F.lit("a) "), line).alias("claim"), own.alias("citation")))
    body = F.to_json(F.struct(F.col("text").alias("answer"), claims.alias("claims"), F.lit(True).alias("sufficient")))
    kind = F.col("doc_id") % 5
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).when(kind == 3, F.lit('{"answer": "INSUFFICIENT_EVIDENCE", "claims": [], "sufficient": true}')).otherwise(F.left(body, F.length(body) - 1))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), raw.alias("raw"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def owned_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.max("turn").alias("last")).select("conv_id", (F.col("conv_id") % 7).alias("visitor"), (F.col("conv_id") * 13 % 101).alias("updated"), F.col("last"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of visitors, with the tokens that each asks for."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("visitor"), (F.col("event_id") % 50).alias("key"), (F.col("event_id") * 37 % 4000).alias("tokens"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confidence for each labelled document, answerable where its quality is good."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    spread = (F.col("doc_id") * 7919 % 1000) / 1000.0
    return d.select("doc_id", "lang", (F.col("quality") == 1).alias("answerable"), F.round(F.when(F.col("quality") == 1, 0.4 + 0.6 * spread).otherwise(0.7 * spread), 4).alias("confidence"))

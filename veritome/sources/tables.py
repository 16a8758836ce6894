"""Tables in and out. Chunk tables are partitioned by owner, so reads of one owner prune the rest."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

GOLDEN = "id string, question string, gold_spec string, gold_version string, gold_clause string, gold_chunk_id string, reference_answer string, question_type string, difficulty string, verified_by_human boolean, type_source string"
ADVERSARIAL = "id string, family string, question string, why_unanswerable string, expected string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, or in the warehouse where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder: they aren't computed again, and nothing of them stays in the session's memory."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def missing(error: Exception) -> bool:
    """Whether an analysis error says that there is no such path, or no file at it."""
    return any(name in str(error) for name in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"))


def documents_in(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(path, bytes, content) of a folder's files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("bytes"), "content")


def parsed_pages(files: DataFrame, parse: Callable[[bytes], Iterator[str]]) -> DataFrame:
    """(path, page_number, text) by a parser for one file's bytes; the parser is the caller's, as no PDF library is assumed."""

    def pages(frames):
        import pandas as pd

        for frame in frames:
            rows = [(path, i, text) for path, content in zip(frame["path"], frame["content"], strict=True) for i, text in enumerate(parse(content), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text"])

    return files.select("path", "content").mapInPandas(pages, "path string, page_number int, text string")


def html_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> (doc_id, page_number, text): scripts and styles go, block ends become line ends, tags go."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|title|nav|article|ul)>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), text.alias("text"))


def dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON dataset; an empty table if the file is missing."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as error:
        if not missing(error):
            raise
        return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    """Records, one JSON object a line, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def dataset_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """What write_json() wrote."""
    return spark.read.schema(schema).json(path)


def create_store(spark: SparkSession, folder: str) -> dict[str, str]:
    """Makes the tables of the conversation store, and returns their paths by name; turns are partitioned by conversation, which takes an index's place."""
    mark = folder.rsplit("-", 1)[-1]
    columns = {
        "conversations": "conv_id BIGINT, visitor BIGINT, title STRING, updated BIGINT, part INT",
        "turns": "conv_id BIGINT, turn BIGINT, role STRING, text STRING, sources STRING, part INT",
    }
    for name, of in columns.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{mark} ({of}) USING parquet PARTITIONED BY (part) LOCATION '{folder}/{name}'")
    return {name: f"{folder}/{name}" for name in columns}


def recreate(df: DataFrame, path: str) -> None:
    """Drops what is at the path, if anything, and writes the table anew."""
    df.write.mode("overwrite").parquet(path)


def with_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """pages of documents (doc_id); a document of which no page is left is an error."""
    lost = documents.select("doc_id").join(pages.select("doc_id"), "doc_id", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"no page is left of {[r[0] for r in lost]}")
    return pages


def appended_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log that is partitioned by day."""
    rows.write.mode("append").partitionBy("day").parquet(path)


def with_unique(df: DataFrame, key: str) -> DataFrame:
    """df, whose evaluation fails if a key occurs twice."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{key} occurs more than once: {[r[0] for r in twice]}")
    return df


def with_one_length(df: DataFrame) -> DataFrame:
    """df, whose vectors, if it has any, must be of one length."""
    if "vector" in df.columns and len(sizes := df.select(F.size("vector")).distinct().limit(2).collect()) > 1:
        raise ValueError(f"vectors have several lengths, such as {[r[0] for r in sizes]}")
    return df


def append_chunks(chunks: DataFrame, path: str, owner: str) -> None:
    """Adds an owner's chunks; repeated ids are an error, those of the table included, and so are vectors of several lengths."""
    append_owned(chunks.withColumn("owner", F.lit(owner)), path)


def append_owned(chunks: DataFrame, path: str) -> None:
    """Like append_chunks, of many owners, each named in its row."""
    new = with_one_length(with_unique(chunks, "chunk_id"))
    try:
        known = chunks.sparkSession.read.parquet(path).select("chunk_id")
        clash = new.join(known, "chunk_id", "left_semi").limit(1).count()
    except AnalysisException as error:
        if not missing(error):
            raise
        clash = 0
    if clash:
        raise ValueError("chunk ids are already in the table")
    new.write.mode("append").partitionBy("owner").parquet(path)


def owned(spark: SparkSession, path: str, *owners: str) -> DataFrame:
    """The chunks of these owners; other owners' partitions aren't read."""
    return spark.read.parquet(path).where(F.col("owner").isin(*owners))


def delete_owner(spark: SparkSession, path: str, owner: str) -> int:
    """Deletes an owner's chunks and returns how many went: only that owner's partition is read, and its folder is deleted; no other owner's files are read, written or moved.

    Readers that have planned a scan of this owner fail, those of others don't. A run that breaks off is repeated as it is.
    """
    try:
        files = owned(spark, path, owner).groupBy(F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("folder")).count().collect()
    except AnalysisException as error:
        if not missing(error):
            raise
        return 0
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in files:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["folder"]))
        folder.getFileSystem(conf).delete(folder, True)
    return sum(row["count"] for row in files)


def row_count(spark: SparkSession, path: str) -> int:
    """0 for a table that isn't there."""
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as error:
        if not missing(error):
            raise
        return 0


def write_manifest(spark: SparkSession, path: str, model: str, dimension: int) -> None:
    spark.range(1).select(F.lit(model).alias("embedding_model"), F.lit(dimension).alias("embedding_dim"), F.lit("cosine").alias("space")).coalesce(1).write.mode("overwrite").json(path)


def checked_vectors(spark: SparkSession, path: str, manifest: str, model: str) -> DataFrame:
    """The vectors, if the manifest names the model that queries are embedded with."""
    found = spark.read.json(manifest).first()["embedding_model"]
    if found != model:
        raise ValueError(f"vectors were made with {found!r}, queries with {model!r}")
    return spark.read.parquet(path)


def _direction(token: Column, dimension: int) -> tuple[Column, Column]:
    """Which component of an embedding a token adds to, and its sign, both from its MD5."""
    digest = F.md5(token)
    at = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % dimension
    return at, F.when(F.substring(digest, 5, 1) < "8", 1.0).otherwise(-1.0)


#: Stands before a question, not before a passage, when it is embedded.
QUERY_PREFIX = "passage for the question "


def hashed_embedding(text: str, dimension: int = 64):
    """A deterministic stand-in for an embedding model: signed hashed term frequencies, of unit length."""
    from veritome.functions.text import tokens

    def entry(t):
        at, sign = _direction(t, dimension)
        return F.struct(at.alias("at"), sign.alias("sign"))

    rows = F.transform(tokens(F.col(text)), entry)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(F.filter(rows, lambda r: r["at"] == i), F.lit(0.0), lambda s, r: s + r["sign"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def embedded(rows: DataFrame, key: str, text: str, dimension: int = 64, prefix: str = "") -> DataFrame:
    """(key, vector): hashed_embedding of every text, after the prefix, as sums over its exploded tokens; texts without a token of their own or a direction have no row."""
    from veritome.functions.text import tokens

    found = rows.select(key, F.explode(tokens(F.when(F.size(tokens(F.col(text))) > 0, F.concat(F.lit(prefix), F.col(text))))).alias("t"))
    at, sign = _direction(F.col("t"), dimension)
    sums = found.groupBy(key, at.alias("at")).agg(F.sum(sign).alias("x")).where("x <> 0")
    each = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("xs"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return each.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("xs", i), F.lit(0.0)) / F.col("norm")).alias("vector"))

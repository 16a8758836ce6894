"""A training corpus from raw documents, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm import decontaminate, jaccard, mixing, quality, spans
from veritome.llm.runtime import shared_folder, table, without_ids

#: Shares of the tokens; low quality is what the first stage drops.
TARGETS = {"clean": 0.94, "toxic": 0.06}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours reject go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs.select("doc_id", "text"), labels)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names of the documents' columns may be those of the results
    scored = quality.score(plain.withColumn("text", F.col(f"c{docs.columns.index('text')}")), model)
    return scored.where("predicted = 1").select(*plain.columns).toDF(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity connects the one with the smallest id stays."""
    groups = jaccard.near_duplicate_groups(docs)
    return without_ids(docs, groups.where("component_id < doc_id").select("doc_id"), "doc_id")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again are cut from the texts."""
    return spans.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets the rate at which it is to be drawn."""
    return mixing.target_rates(docs, mixing.labelled_domains(table(spark, sf_dir, "labels")), TARGETS)


STAGES = [("quality", keep_quality), ("jaccard", keep_one_of_each_group), ("substrings", cut_repeats), ("decontaminate", drop_contaminated), ("mix", mix)]

#: The first stage's classifier and the last one's rates can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

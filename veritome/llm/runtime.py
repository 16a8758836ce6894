"""What the operators share on the Spark side: durable intermediate results and partition counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; where none is named, a new one in the warehouse, which all executors share as well."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}")
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder: lost executors don't take them along, and they aren't computed again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like durable, as a Parquet table: compressed, and read by column."""
    folder = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: So many blocks for each partition of the input, which Spark cuts to a bounded number of bytes.
BLOCKS_A_PARTITION = 2


def blocks_of(df: DataFrame) -> int:
    """Into how many blocks rows of df are dealt by hash: in proportion to the input, whatever the setting of shuffle partitions, so that a block stays small."""
    return BLOCKS_A_PARTITION * max(partitions(df.sparkSession), df.rdd.getNumPartitions())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


#: So many ids, of 8 bytes each, may be broadcast.
IDS = 1_000_000


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key isn't in ids (one column): a broadcast up to IDS of them, else a shuffled join."""
    ids = durable(ids.toDF("gone").distinct())
    found = F.broadcast(ids) if ids.count() <= IDS else ids
    return df.join(found, df[key].eqNullSafe(found["gone"]), "left_anti")

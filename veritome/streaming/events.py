"""Streaming counts, sliding sums, sessions and incremental ingestion. Event times are cast to timestamps before a watermark is set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, visitor, used): requests by visitor in windows of a day."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "visitor").agg(F.count("*").alias("used")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "visitor", "used")


def sliding_usage(events: DataFrame, seconds: int = 60, step: int = 10, late: str = "10 minutes") -> DataFrame:
    """(start, requests, tokens) in overlapping windows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", f"{seconds} seconds", f"{step} seconds").alias("w")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("start"), "requests", "tokens")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(visitor, start, stop, requests): a visitor's requests without a longer gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "visitor").agg(F.count("*").alias("requests")).select("visitor", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "requests")


def ingest_stream(pages: DataFrame, to_chunks: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Chunks of new pages are added to a table, once for each id; the query that does so."""

    def add(batch: DataFrame, number: int) -> None:
        chunks = to_chunks(batch).dropDuplicates(["chunk_id"])
        try:
            chunks = chunks.join(batch.sparkSession.read.parquet(path).select("chunk_id"), "chunk_id", "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        chunks.write.mode("append").parquet(path)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def saved_increments(items: DataFrame, path: str, checkpoint: str):
    """Each micro-batch is written to a folder of its own number, which a repeated run writes again; the query that does so."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return items.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admission_stream(requests: DataFrame, seconds: int = 60, tokens: int = 6000, most: int = 30) -> DataFrame:
    """requests (key, event_id, ts, tokens) -> (key, event_id, decision), with the admitted requests of the last seconds as each key's state."""

    def admit(key, frames, state):
        import pandas as pd

        recent = list(state.get[0]) if state.exists else []
        out = []
        for frame in frames:
            for at, event, n in frame.sort_values(["ts", "event_id"])[["ts", "event_id", "tokens"]].itertuples(index=False):
                micros = int(at.value // 1000)
                recent = [r for r in recent if micros - r[0] <= seconds * 1_000_000]
                fits = n <= tokens and len(recent) < most and sum(r[1] for r in recent) + n <= tokens
                if fits:
                    recent.append((micros, int(n)))
                out.append((key[0], event, "admitted" if fits else "too_large" if n > tokens else "wait"))
        state.update(([(a, b) for a, b in recent],))
        yield pd.DataFrame(out, columns=["key", "event_id", "decision"])

    return requests.groupBy("key").applyInPandasWithState(admit, "key long, event_id long, decision string", "recent array<struct<at:long,tokens:long>>", "append", "NoTimeout")

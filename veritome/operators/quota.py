"""Daily quotas and the sliding window of a rate limiter."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.config import DEFAULT, Config


def quota_state(events: DataFrame) -> DataFrame:
    """events (ts, visitor) -> (day, visitor, used)."""
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "visitor").agg(F.count("*").alias("used"))


def quota_decisions(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """events (event_id, ts, visitor) -> adds day, own_before, decision and remaining.

    A request is granted if fewer than visitor_limit of the visitor's, and fewer than global_limit of all, were granted that day before it.
    The visitor's own requests are granted up to the limit in order; the day's count is then over those only, and in two steps, by second and within, so that a busy day isn't
    one task's running sum, nor is a busy hour.
    """
    rows = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("second", F.date_format("ts", "HH:mm:ss"))
    own = W.partitionBy("day", "visitor").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("own_before", F.count("*").over(own)).withColumn("within", F.col("own_before") < cfg.visitor_limit)
    hours = rows.groupBy("day", "second").agg(F.count_if("within").alias("n"))
    carried = hours.withColumn("carried", F.coalesce(F.sum("n").over(W.partitionBy("day").orderBy("second").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = W.partitionBy("day", "second").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.count_if("within").over(inside)).join(carried, ["day", "second"])
    all_before = F.col("carried") + F.col("inside")
    decision = F.when(all_before >= cfg.global_limit, "global_limit").when(~F.col("within"), "visitor_limit").otherwise("granted")
    return rows.select("event_id", "ts", "visitor", "day", "own_before", decision.alias("decision"), F.when(decision == "granted", cfg.visitor_limit - 1 - F.col("own_before")).otherwise(0).alias("remaining"))


def quota_report(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    state = quota_state(events)
    return state.groupBy("day").agg(F.sum("used").alias("used"), F.count("*").alias("visitors"), F.count_if(F.col("used") >= cfg.visitor_limit).alias("exhausted"))


#: So many windows are a slice of a key's history.
WINDOWS_A_SLICE = 60


def rate_window(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """events (event_id, ts, tokens, key) -> adds what was used in the seconds before each event, itself included, and whether that is within bounds.

    A key's history is cut into slices of time, each with a copy of the events in the window before it, so a busy key isn't one task.
    """
    span = cfg.window_seconds * 1_000_000
    length, at = span * WINDOWS_A_SLICE, F.col("micros")
    piece = F.floor(at / length)
    own, next_too = F.struct(piece.alias("slice"), F.lit(True).alias("own")), F.struct((piece + 1).alias("slice"), F.lit(False).alias("own"))
    rows = events.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.withColumn("piece", F.explode(F.when(at >= (piece + 1) * length - span, F.array(own, next_too)).otherwise(F.array(own))))
    frame = W.partitionBy("key", "piece.slice").orderBy("micros").rangeBetween(-span, 0)
    rows = rows.withColumn("tokens_used", F.sum("tokens").over(frame)).withColumn("requests", F.count("*").over(frame)).where("piece.own")
    return rows.withColumn("within", (F.col("tokens_used") <= cfg.tokens_per_minute) & (F.col("requests") <= cfg.requests_per_minute)).drop("micros", "piece")


def admitted(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """events (event_id, ts, tokens, key) -> (event_id, key, decision): admission feeds back, as refused events don't count, so each key's events are folded in order.

    A key's history is cut where it is idle for longer than the window, after which nothing is remembered; each part is read in order of time, in batches, and only the
    admitted events of the last seconds are kept meanwhile.  Decisions: admitted, wait, or too_large for the whole budget.
    """
    span = cfg.window_seconds * 1_000_000
    order = W.partitionBy("key").orderBy("at", "event_id")
    rows = events.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("tokens").cast("long").alias("tokens"))
    idle = F.coalesce(F.col("at") - F.lag("at").over(order) > span, F.lit(True)).cast("int")
    parts = rows.withColumn("idle", idle).withColumn("part", F.sum("idle").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("idle")

    def fold(frames):
        import pandas as pd

        own, recent, used = None, deque(), 0
        for frame in frames:
            out = []
            for key, part, event, at, tokens in frame[["key", "part", "event_id", "at", "tokens"]].itertuples(index=False, name=None):
                if own != (key, part):
                    own, recent, used = (key, part), deque(), 0
                while recent and at - recent[0][0] > span:
                    used -= recent.popleft()[1]
                fits = tokens <= cfg.tokens_per_minute and len(recent) < cfg.requests_per_minute and used + tokens <= cfg.tokens_per_minute
                if fits:
                    recent.append((at, tokens))
                    used += tokens
                out.append((event, key, "admitted" if fits else "too_large" if tokens > cfg.tokens_per_minute else "wait"))
            yield pd.DataFrame(out, columns=["event_id", "key", "decision"])

    kinds = f"event_id {rows.schema['event_id'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, decision string"
    return parts.repartition("key", "part").sortWithinPartitions("key", "part", "at", "event_id").mapInPandas(fold, kinds)

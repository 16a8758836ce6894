"""Admission of requests on a stream, in order of event time: the state of a key is what still waits for the watermark, and what was admitted in the last seconds.

A request is decided when the watermark has passed it, for then no earlier one can come; one that is later than the watermark allows is dropped by Spark, which counts it in the query's progress.
So decisions are those of quota.admitted on the same requests, whatever order they arrive in.  Timers wake a key at its first waiting request and, when it has none, at the end of the window
of its last admitted one, after which the key has no state.  A key's state is bounded by its requests within the lateness allowed and the window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from veritome.config import DEFAULT, Config

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decided(waiting: list[tuple], recent: list[tuple], cfg: Config = DEFAULT) -> tuple[list[tuple], list[tuple]]:
    """Requests (at, event, tokens) in order of time, after the admitted ones (at, tokens): (event, decision) of each, and what is admitted of the last seconds. Times are in microseconds."""
    span, first, used, out = cfg.window_seconds * 1_000_000, 0, sum(n for _, n in recent), []
    recent = list(recent)
    for at, event, tokens in waiting:
        while first < len(recent) and at - recent[first][0] > span:
            used -= recent[first][1]
            first += 1
        fits = used + tokens <= cfg.tokens_per_minute and len(recent) - first < cfg.requests_per_minute
        if fits:
            recent.append((at, tokens))
            used += tokens
        out.append((event, "admitted" if fits else "too_large" if tokens > cfg.tokens_per_minute else "wait"))
    return out, recent[first:]


class Admission(StatefulProcessor):
    def __init__(self, cfg: Config):
        self.cfg = cfg

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event long, tokens long")
        self.recent = handle.getListState("recent", "at long, tokens long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        first = None
        for frame in rows:
            came = list(zip(frame["at"].tolist(), frame["event_id"].tolist(), frame["tokens"].tolist(), strict=True))
            if came:
                self.waiting.appendList(came)
                first = min(came)[0] if first is None else min(first, min(came)[0])
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in waiting if r[0] <= now]
        out, recent = decided(due, [tuple(r) for r in self.recent.get()], self.cfg)
        recent = [r for r in recent if r[0] + self.cfg.window_seconds * 1_000_000 >= now]
        later = waiting[len(due) :]
        for state, left in ((self.waiting, later), (self.recent, recent)):
            if left:
                state.put(left)
            else:
                state.clear()
        if later:
            self._wake(later[0][0])
        elif recent:
            self._wake(recent[-1][0] + self.cfg.window_seconds * 1_000_000 + 1)
        yield pd.DataFrame({"key": [key[0]] * len(out), "event_id": [e for e, _ in out], "decision": pd.Series([d for _, d in out], dtype=object)})  # strings of pandas's own are chunked, which Spark refuses

    def close(self) -> None:
        pass

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))


def timed_admission(requests: DataFrame, late: str = "1 minute", cfg: Config = DEFAULT) -> DataFrame:
    """A stream of requests (key, event_id, ts, tokens) -> (key, event_id, decision). The query has to run with the state store ROCKS (see `run`)."""
    rows = requests.select("key", "event_id", "ts", F.unix_micros("ts").alias("at"), F.col("tokens").cast("long").alias("tokens")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Admission(cfg), "key long, event_id long, decision string", "Append", "EventTime")


def run(stream: DataFrame, path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] = timed_admission) -> None:
    """Takes the stream's new rows, and adds what is decided to the table at the path; state and progress stay in the checkpoint for the next run."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        query = build(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
    query.awaitTermination()

"""Event-time admission on a stream against a plain loop, late and idle keys included."""

import datetime as dt
import random

from tests.test_admission import plain
from veritome.plans import catalog  # noqa: F401
from veritome.plans import stores
from veritome.plans import derived as D
from veritome.operators import quota
from veritome.streaming import admission

SCHEMA = "event_id long, ts timestamp, key long, tokens long"
START = dt.datetime(2024, 1, 1)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(folder)


def left(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def test_any_order_within_the_lateness_and_no_state_of_idle_keys(spark, tmp_path):
    random.seed(5)
    rows, at = [], START
    for i in range(400):
        at += dt.timedelta(seconds=random.choice((0, 0, 1, 2, 5, 30, 61)), microseconds=random.choice((0, 1, 999)))
        rows.append((i, at, random.choice((1, 1, 2)), random.choice((10, 200, 900, 3000, 7000))))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    arrival = sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=random.randrange(55)), r[0]))
    parts = [arrival[:150], arrival[150:280], arrival[280:], [(-1, at + dt.timedelta(minutes=10), 99, 1)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(source)
        admission.run(stream(spark, source), out, state)
    got = {r.event_id: r.decision for r in spark.read.parquet(out).collect()}
    assert got == plain(rows)
    assert left(spark, state, "recent").count() == 0
    assert [r.key.key for r in left(spark, state, "waiting").collect()] == [99]


def test_a_request_behind_the_watermark_is_dropped(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for event, minute in ((1, 10), (2, 2), (3, 10), (4, 60)):
        spark.createDataFrame([(event, START + dt.timedelta(minutes=minute), 1, 100)], SCHEMA).write.mode("append").parquet(source)
        admission.run(stream(spark, source), out, state)
    assert sorted((r.event_id, r.decision) for r in spark.read.parquet(out).collect()) == [(1, "admitted"), (3, "admitted")]


def test_the_query_equals_the_batch_form(spark, sf_dir):
    got = {(r.event_id, r.key, r.decision) for r in stores.rate_admission_stream(spark, sf_dir).collect()}
    want = [(r.event_id, r.key, r.decision) for r in quota.admitted(D.requests(spark, sf_dir)).collect()]
    assert len(want) == len(got) and got == set(want)

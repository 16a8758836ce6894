"""Admission by a plain loop over each key's requests."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from veritome.config import DEFAULT
from veritome.operators import evals, quota
from veritome.sources import tables


def plain(rows):
    recent, out = defaultdict(list), {}
    for event, ts, key, tokens in sorted(rows, key=lambda r: (r[1], r[0])):
        recent[key] = [r for r in recent[key] if (ts - r[0]).total_seconds() <= DEFAULT.window_seconds]
        fits = tokens <= DEFAULT.tokens_per_minute and len(recent[key]) < DEFAULT.requests_per_minute and sum(r[1] for r in recent[key]) + tokens <= DEFAULT.tokens_per_minute
        if fits:
            recent[key].append((ts, tokens))
        out[event] = "admitted" if fits else "too_large" if tokens > DEFAULT.tokens_per_minute else "wait"
    return out


def test_admission_matches_a_plain_loop(spark):
    random.seed(3)
    rows, at = [], dt.datetime(2024, 1, 1)
    for i in range(1500):
        at += dt.timedelta(seconds=random.choice((0, 0, 1, 2, 5, 30, 61, 90)))
        rows.append((i, at, random.choice((1, 1, 1, 2, 3)), random.choice((10, 200, 900, 3000, 7000))))
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, key long, tokens long").repartition(4)
    assert {r.event_id: r.decision for r in quota.admitted(events).collect()} == plain(rows)
    assert quota.admitted(events.limit(0)).count() == 0


def test_rate_window_across_slices(spark):
    """Events on both sides of the ends of slices, some exactly a window apart, and one without a time."""
    random.seed(6)
    end = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=DEFAULT.window_seconds * quota.WINDOWS_A_SLICE)
    rows = [(i, end + dt.timedelta(seconds=random.randrange(-150, 150)), random.choice((1, 2)), random.randrange(900)) for i in range(400)] + [(1000, None, 1, 5)]
    got = {r.event_id: (r.tokens_used, r.requests) for r in quota.rate_window(spark.createDataFrame(rows, "event_id long, ts timestamp, key long, tokens long")).collect()}
    timed = rows[:-1]
    for i, ts, key, _ in timed:
        near = [r[3] for r in timed if r[2] == key and 0 <= (ts - r[1]).total_seconds() <= DEFAULT.window_seconds]
        assert got[i] == (sum(near), len(near))
    assert len(got) == len(rows) and got[1000] == (5, 1)


def test_medians_and_vectors_of_several_lengths(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", 8.0), ("b", 2.0), ("b", None), ("b", 9.0), ("b", 9.0), ("c", None)], "k string, v double")
    assert {r.k: r.median for r in evals.medians(rows, "v", ["k"]).collect()} == {"a": 3.0, "b": 9.0}
    bad = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "chunk_id long, vector array<double>")
    with pytest.raises(ValueError, match="several lengths"):
        tables.append_chunks(bad, str(tmp_path / "t"), "base")
    pages = spark.createDataFrame([(1,)], "doc_id long")
    with pytest.raises(ValueError, match="no page"):
        tables.with_pages(spark.createDataFrame([(1,), (2,)], "doc_id long"), pages)

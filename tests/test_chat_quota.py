import datetime as dt

import pytest
from pyspark.sql import functions as F

from veritome.config import Config
from veritome.operators import chat, quota

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(
    ("text", "history", "name", "billable"),
    [
        ("", False, "UNCLEAR", False), ("x", False, "UNCLEAR", False), ("Hello there!", False, "GREETING", False), ("thanks", True, "GREETING", False), ("hello hello hello", False, "GREETING", False), ("test, test", False, "GREETING", False),
        ("what can you do?", False, "META", False), ("which specs do you have", False, "META", False), ("what about the UPF?", True, "FOLLOW_UP", True), ("what about the UPF?", False, "SPEC_QUESTION", True), ("5QI", False, "UNCLEAR", False),
        ("do you like cricket today", False, "AMBIGUOUS", False), ("What is the granularity of the measurement?", False, "SPEC_QUESTION", True),
    ],
)
def test_intents(spark, text, history, name, billable):
    got = spark.range(1).select(chat.intent(F.lit(text), F.lit(history)).alias("i")).first().i
    assert (got.intent, got.billable) == (name, billable)


def turns(spark, n=20):
    return spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(n)] + [(2, 0, "assistant", "hi"), (2, 1, "user", " " + "t" * 70)], TURNS)


def test_history_and_titles(spark):
    got = chat.history(turns(spark).where("conv_id = 1"))
    assert sorted(r.turn for r in got.collect()) == list(range(12, 20)) and got.columns == ["conv_id", "turn", "role", "text"]
    titles = {r.conv_id: r.title for r in chat.conversations(turns(spark)).collect()}
    assert titles == {1: "turn 0", 2: "t" * 60 + "…"}
    assert chat.conversations(spark.createDataFrame([(3, 0, "system", "x")], TURNS)).first().title == "New conversation"


def test_rewrites(spark):
    rows = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(("What is the counter of the cell?", "a" * 400, "and the alarm?"))], TURNS)
    got = chat.rewrite_inputs(rows).collect()
    assert [(r.turn, len(r.context.split("\n")[1])) for r in got] == [(2, len("assistant: ") + 300)]
    rewrites = spark.createDataFrame([(1, 2, "What is the alarm of the cell?")], "conv_id long, turn long, rewrite string")
    assert chat.rewritten(rows.where("turn = 2"), rewrites).first().changed is True
    assert chat.rewritten(rows.where("turn = 2"), rewrites.withColumn("rewrite", F.repeat(F.lit("x"), 401))).first().query == "and the alarm?"


def test_store(spark):
    convs = spark.createDataFrame([(1, "v", 5), (2, "v", 9), (3, "w", 1)], "conv_id long, visitor string, updated long")
    listed = chat.conversation_list(convs, turns(spark), F.col("visitor") == "v").orderBy("rank").collect()
    assert [(r.conv_id, r.turns) for r in listed] == [(2, 2), (1, 20)]
    left, rest = chat.deleted(convs, turns(spark), spark.createDataFrame([(1, "w"), (2, "v")], "conv_id long, visitor string"))
    assert sorted(r.conv_id for r in left.collect()) == [1, 3] and {r.conv_id for r in rest.collect()} == {1}
    assert chat.existing(spark.createDataFrame([(1, "v"), (1, "w")], "conv_id long, visitor string"), convs).count() == 1
    new = chat.appended(turns(spark), spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "user", "a"), (9, 1, "user", "c")], "conv_id long, at long, role string, text string"))
    assert sorted((r.conv_id, r.turn, r.text) for r in new.collect()) == [(1, 20, "a"), (1, 21, "b"), (9, 0, "c")]


def test_ambiguous_turns_are_resolved(spark):
    rows = spark.createDataFrame([(1, 0, "AMBIGUOUS", False), (1, 1, "AMBIGUOUS", False), (1, 2, "GREETING", False)], "conv_id long, turn long, intent string, billable boolean")
    judged = spark.createDataFrame([(1, 0, "TECHNICAL")], "conv_id long, turn long, category string")
    assert [(r.intent, r.billable) for r in chat.resolved_intents(rows, judged).orderBy("turn").collect()] == [("SPEC_QUESTION", True), ("META", False), ("GREETING", False)]


def at(second, day=1):
    return dt.datetime(2024, 1, day) + dt.timedelta(seconds=second)


def test_quota_matches_a_running_count(spark):
    import random

    random.seed(2)
    cfg = Config(visitor_limit=3, global_limit=12)
    rows = [(i, at(random.randrange(86_400), 1 + i % 2), i % 9) for i in range(80)]
    got = {r.event_id: r.decision for r in quota.quota_decisions(spark.createDataFrame(rows, "event_id long, ts timestamp, visitor long"), cfg).collect()}
    used, total = {}, {}
    for i, ts, v in sorted(rows, key=lambda r: (r[1], r[0])):
        day = ts.date()
        want = "global_limit" if total.get(day, 0) >= 12 else "visitor_limit" if used.get((day, v), 0) >= 3 else "granted"
        if want == "granted":
            total[day] = total.get(day, 0) + 1
            used[day, v] = used.get((day, v), 0) + 1
        assert got[i] == want


def test_admission_feeds_back(spark):
    rows = [(1, at(0), 4000, 1), (2, at(1), 4000, 1), (3, at(2), 2000, 1), (4, at(61), 4000, 1), (5, at(62), 7000, 1)]
    got = quota.admitted(spark.createDataFrame(rows, "event_id long, ts timestamp, tokens long, key long"))
    assert {r.event_id: r.decision for r in got.collect()} == {1: "admitted", 2: "wait", 3: "admitted", 4: "admitted", 5: "too_large"}
    window = quota.rate_window(spark.createDataFrame(rows, "event_id long, ts timestamp, tokens long, key long"))
    assert {r.event_id: r.tokens_used for r in window.collect()} == {1: 4000, 2: 8000, 3: 10000, 4: 10000, 5: 13000}

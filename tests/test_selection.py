"""Quantiles and medians by ranges, against sorted lists."""

import random
from statistics import median

import pytest

from veritome.operators import evals

SHARES = [0.0, 0.05, 0.5, 0.95, 1.0]


@pytest.fixture()
def many_ranges(spark):
    """Every range of the sort stays a partition of its own, however small."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def sample():
    random.seed(4)
    values = {"hot": [random.randrange(0, 900) / 7 for _ in range(5000)], "same": [2.5] * 300, "one": [-1.0], None: [random.gauss(0, 1) for _ in range(40)]}
    return values, [(k, v) for k, vs in values.items() for v in vs] + [("hot", None), ("none", None)]


def test_quantiles_match_sorted_lists(spark, many_ranges):
    values, rows = sample()
    random.shuffle(rows)
    got = evals.quantiles_by_rank(spark.createDataFrame(rows, "k string, v double").repartition(5), "v", SHARES, ["k"]).collect()
    want = {(k, s): sorted(vs)[min(len(vs) - 1, int(len(vs) * s))] for k, vs in values.items() for s in SHARES}
    assert len(got) == len(want) and {(r.k, r.share): r.value for r in got} == want


def test_medians_match_and_a_hot_key_is_several_ranges(spark, many_ranges, monkeypatch):
    values, rows = sample()
    kept, durable = [], evals.durable
    monkeypatch.setattr(evals, "durable", lambda df: kept.append(durable(df)) or kept[-1])
    got = {r.k: r.median for r in evals.medians(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    assert got == {k: pytest.approx(median(vs)) for k, vs in values.items()}
    assert kept[0].where("_key.k = 'hot'").select("_range").distinct().count() > 1


def test_two_keys_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a", 3), (1, "a", 1), (1, "b", 7), (2, None, 5)], "x long, y string, v long")
    assert sorted(map(str, ((r.x, r.y, r.median) for r in evals.medians(rows, "v", ["x", "y"]).collect()))) == ["(1, 'a', 2.0)", "(1, 'b', 7.0)", "(2, None, 5.0)"]
    assert evals.medians(rows.limit(0), "v", ["x"]).collect() == [] == evals.quantiles_by_rank(rows.limit(0), "v", [0.5], ["x"]).collect()

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritome.config import Config
from veritome.functions import text as X
from veritome.operators import evals, retrieve


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_tokens_keep_and_split_compounds(spark):
    assert one(spark, X.tokens(F.lit("gNB-CU-UP and 28.552, é x_y"))) == ["gnb-cu-up", "gnb", "cu", "up", "and", "28.552", "28", "552", "x_y", "x", "y"]


def lists(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "query_id int, list_no int, rank int, chunk_id string")


def test_fusion_ties_go_to_first_seen(spark):
    got = retrieve.fused(lists(spark, (1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "a"))).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b"]
    assert got[0].score == round(1 / 61 + 1 / 62, 9)


def test_fusion_prefers_agreement_and_cuts(spark):
    rows = lists(spark, (1, 1, "x"), (1, 2, "both"), (2, 1, "y"), (2, 2, "both"))
    assert [r.chunk_id for r in retrieve.fused(rows, top_n=1).collect()] == ["both"]


def okapi(docs, query, k1=1.5, b=0.75, eps=0.25):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else eps * mean for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avg)) for t in query) for d in docs]


def test_bm25_matches_the_formula(spark):
    texts = ["the alarm list of the cell", "cell counter and the alarm", "the the the", "nothing here but words of the corpus", "handover counter"]
    want = okapi([t.split() for t in texts], "the alarm alarm counter".split())
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    got = retrieve.bm25_search(spark.createDataFrame([(7, "the Alarm alarm counter")], "query_id int, question string"), chunks).collect()
    assert {r.chunk_id: r.score for r in got} == {i: round(s, 6) for i, s in enumerate(want) if s > 0}
    assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"])] == sorted((i for i, s in enumerate(want) if s > 0), key=lambda i: -want[i])


def test_session_merge_reads_base_first(spark):
    base = spark.createDataFrame([(1, 1, "a", 2.0), (1, 2, "b", 1.0)], "query_id int, rank int, chunk_id string, score double")
    session = spark.createDataFrame([(1, 1, "s", 2.0)], base.schema)
    assert [r.chunk_id for r in retrieve.merged_search(base, session, 2).orderBy("rank").collect()] == ["a", "s"]


def test_dense_search_is_scoped(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0], "base"), ("mine", [0.9, 0.1], "s1"), ("other", [1.0, 0.0], "s2")], "chunk_id string, vector array<float>, owner string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "s1")], "query_id int, vector array<float>, session string")
    assert [r.chunk_id for r in retrieve.dense_search(q, v, owners=True).orderBy("rank").collect()] == ["b", "mine"]
    assert [r.chunk_id for r in retrieve.dense_search(q, v, k=2).orderBy("rank").collect()] == ["b", "other"]


@pytest.mark.parametrize("owners", [False, True])
@pytest.mark.parametrize(("queries", "tile"), [(10_000, (1000, 2000)), (7, (3, 5))])
def test_dense_search_multiplies_blocks(spark, monkeypatch, owners, queries, tile):
    """No join of all pairs; blocks, tiles, ties and odd vectors, as by hand: a null one comes last, one of length 0 has a score of 0."""
    monkeypatch.setattr(retrieve, "QUERIES", queries)
    monkeypatch.setattr(retrieve, "TILE", tile)
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 19 == 7 else [0.0] * 4 if i % 17 == 3 else [float(x) for x in rng.integers(-2, 3, 4)], ("base", "s1", "s2", None)[i % 4]) for i in range(90)]
    v = spark.createDataFrame(rows, "chunk_id long, vector array<float>, owner string").repartition(3)
    asked = [(i, x, ("s1", "s2", None, "s9")[i % 4]) for i, x, _ in rows[:31]]
    q = spark.createDataFrame(asked, "query_id long, vector array<float>, session string")

    def score(x, y):
        return None if x is None or y is None else round(np.dot(x, y) / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-300), 6) + 0.0

    want = []
    for i, x, session in asked:
        seen = [(c, score(x, y)) for c, y, o in rows if not owners or o == "base" or (o is not None and o == session)]
        best = sorted(seen, key=lambda s: (s[1] is None, -(s[1] or 0.0), s[0]))[:40]
        want += [(i, n, c, s) for n, (c, s) in enumerate(best, 1)]
    found = retrieve.dense_search(q, v, 40, owners=owners)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.query_id, r.rank, r.chunk_id, r.score) for r in found.orderBy("query_id", "rank").collect()] == want
    assert retrieve.dense_search(q.limit(0), v).collect() == []


@pytest.mark.parametrize(("score", "tau", "ok"), [(0.20, 0.35, False), (0.50, 0.35, True), (0.35, 0.35, True)])
def test_gate(spark, score, tau, ok):
    rows = spark.createDataFrame([(1, [("c",)], score)], "query_id int, chunks array<struct<chunk_id:string>>, top_score double")
    assert retrieve.gated(rows, tau).first().answerable is ok
    assert retrieve.gated(rows.withColumn("chunks", F.slice("chunks", 1, 0)), 0.0).first().confidence == 0.0


def test_retrieve_drops_missing_chunks_and_blank_questions(spark):
    q = spark.createDataFrame([(1, "alarm list"), (2, " ")], "query_id int, question string")
    c = spark.createDataFrame([("a", "alarm list of things"), ("b", "other")], "chunk_id string, text string")
    got = retrieve.retrieved(q, c, lists(spark, (1, 1, "gone"), (1, 2, "b"), (2, 1, "a"))).collect()
    assert [r.query_id for r in got] == [1]
    assert [x.chunk_id for x in got[0].chunks] == ["a", "b"] and (got[0].dense_hits, got[0].bm25_hits, got[0].fused_candidates) == (2, 1, 2)
    assert [round(s.score, 2) for s in retrieve.retrieved(q, c, lists(spark, (1, 1, "b"), (2, 1, "a")), scorer=None).first().chunks] == [1.0, 0.95]


def test_places_in_sorted_values(spark):
    df = spark.createDataFrame([(float(i), "g") for i in range(100)], "v double, k string")
    got = {r.share: r.value for r in evals.quantiles_by_rank(df, "v", [0.05, 0.5, 0.95, 1.0], ["k"]).collect()}
    assert got == {0.05: 5.0, 0.5: 50.0, 0.95: 95.0, 1.0: 99.0}
    assert one(spark, evals.at_share(F.array(*[F.lit(float(i)) for i in range(100)]), 0.95)) == 95.0


def test_rank_metrics(spark):
    ranked = F.array(*map(F.lit, ("a", "b", "c")))
    assert one(spark, evals.recall_at(ranked, F.lit("c"), 2)) == 0 and one(spark, evals.recall_at(ranked, F.lit("c"), 3)) == 1
    assert one(spark, evals.reciprocal_rank(ranked, F.lit("b"))) == 0.5 and one(spark, evals.reciprocal_rank(ranked, F.lit("z"))) == 0.0


def test_empty_rates_are_null(spark):
    rows = spark.createDataFrame([(1, None, None, "g")], "query_id int, supported boolean, citation string, gold string")
    assert evals.ungrounded_rate(rows).first().ungrounded_rate is None
    assert evals.citation_accuracy(rows).first().citation_accuracy is None


def test_sweep_bounds_and_best(spark):
    rows = spark.createDataFrame([(True, 0.9), (True, 0.6), (False, 0.1), (False, 0.62)], "answerable boolean, confidence double")
    sweep = evals.threshold_sweep(rows).orderBy("tau").collect()
    assert len(sweep) == 21 and all(-1 <= r.separation <= 1 for r in sweep)
    assert evals.best_threshold(evals.threshold_sweep(rows)).first().tau == 0.15
    assert evals.score_overlap(rows).first().overlap == 1


def test_samples_are_stable(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "id long, k string")
    a, b = (sorted(r.id for r in evals.stratified_sample(rows.repartition(n), "k", "id", 10).collect()) for n in (1, 5))
    assert a == b and len(a) == 10 and sum(i % 2 for i in a) == 5
    smoke = evals.smoke_sample(rows, "k", "id").collect()
    assert len(smoke) == 10 and sum(r.k == "a" for r in smoke) >= 3


def test_question_types(spark):
    cases = {"What is the difference between A and B?": "comparison", "Which types of alarms exist?": "enumeration", "How is throughput measured?": "procedural", "What is perceivedSeverity?": "identifier_lookup", "Define a cell.": "definition"}
    for q, kind in cases.items():
        assert one(spark, X.question_type(F.lit(q))) == kind


def test_config_digest():
    assert Config().digest() == Config().digest() != Config(tau=0.5).digest() and len(Config().digest()) == 12

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.brute import contained, deduped, groups
from veritome.llm import quality
from veritome.llm.runtime import table


def written(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages_match_brute_force(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    known, out = {r.doc_id: r for r in docs.collect()}, {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = out[name] = written(spark, stage(spark, docs, sf_dir), tmp_path / name)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        rows = [(r.doc_id, r.text) for r in before.collect()]
        kept = {r.doc_id for r in docs.collect()}
        if name == "quality":
            labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS label")
            model = quality.fit(before.select("doc_id", "text"), labels)
            scores = model.scores(quality.term_counts(pa.array([t for _, t in rows], pa.string())))
            assert kept == {d for (d, _), s in zip(rows, scores, strict=True) if s >= 0.5}
            truth = {r.doc_id: r.label for r in labels.collect()}
            assert np.mean([(d in kept) == bool(y) for d, y in truth.items() if d in known]) > 0.95
        elif name == "jaccard":
            assert kept == {d for d, (_, least) in groups(rows).items() if d == least}
        elif name == "substrings":
            want = {d: n - gone for d, n, gone, _ in deduped(rows)}
            assert {r.doc_id: len(r.text.split()) for r in docs.collect()} == want
            assert all(r.n_chars == len(r.text) for r in docs.collect())
            assert all(r.text == known[r.doc_id].text for r in docs.collect() if want[r.doc_id] == len(known[r.doc_id].text.split()))
        elif name == "decontaminate":
            items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
            assert kept == {d for d, _ in rows} - {d for d, _, _, _ in contained(rows, items)}
        else:
            assert kept == {d for d, _ in rows} and all(r.rate >= 0 for r in docs.collect())
    assert sorted(map(str, pipeline.run(spark, sf_dir).drop("rate", "p_clean", "p_low", "p_toxic").collect())) == sorted(map(str, docs.drop("rate", "p_clean", "p_low", "p_toxic").collect()))


def test_odd_documents_pass_all_stages(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "some words of a text that nobody labelled", "x", "s", 3), (3, "", "y", "s", 0), (4, "word " * 5000, "y", "s", 0)], table(spark, sf_dir, "documents").schema)
    for data in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            stage(spark, data, sf_dir).collect()


def test_documents_may_have_columns_named_like_results(spark, sf_dir):
    extra = ["predicted", "score", "kept_text", "lang_pred", "gone", "row", "c0", "c1", "places", "starts"]
    docs = table(spark, sf_dir, "documents").limit(60)
    for i, name in enumerate(extra):
        docs = docs.withColumn(name, F.lit(i))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns[-len(extra) :] == extra
    rows = docs.collect()
    assert rows and all(r[name] == i for r in rows for i, name in enumerate(extra))

"""Properties that hold on whole tables."""

from pyspark.sql import functions as F

from veritome.operators import ingest
from veritome.plans import catalog
from veritome.plans import derived as D


def test_chunk_ids_are_unique_and_bodies_cover_all_lines(spark, sf_dir):
    pages = D.headed_pages(spark, sf_dir)
    chunks = ingest.chunked(pages, D.identities(spark, sf_dir)).persist()
    assert chunks.count() == chunks.select("doc_id", "chunk_id").distinct().count()
    assert chunks.where(F.length("body") > 1800 * 1.15).count() == 0
    lines = D.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) between 80 and 1500")
    bodies = chunks.groupBy("doc_id").agg(F.array_join(F.collect_list("body"), "\n").alias("bodies"))
    missing = lines.join(bodies, "doc_id", "left").where(~F.coalesce(F.col("bodies").contains(F.regexp_replace("line", r"^\s+|\s+$", "")), F.lit(False)))
    assert missing.count() == 0


def test_abstained_answers_make_no_claims(spark, sf_dir):
    rows = catalog.QUERIES["answer_dag"](spark, sf_dir).collect()
    assert rows and all((r.claims == "[]") == r.abstained and (r.answer is None) == r.abstained for r in rows)


def test_ranks_are_dense_and_follow_scores(spark, sf_dir):
    for name in ("bm25_ranking", "dense_topk", "rrf_fuse"):
        by = {}
        for r in catalog.QUERIES[name](spark, sf_dir).collect():
            by.setdefault(r.query_id, []).append((r["rank"], r.score, r.chunk_id))
        for rows in by.values():
            rows.sort()
            assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and [r[1] for r in rows] == sorted((r[1] for r in rows), reverse=True) and len({r[2] for r in rows}) == len(rows)

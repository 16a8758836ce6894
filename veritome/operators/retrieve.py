"""Lexical and dense retrieval for many queries at once, rank fusion, reranking and the confidence gate.

Ranks are explicit: every ordering names its tie-breaker, scores are rounded before they are ranked, and top-k is a
row_number filter, which Spark turns into a limit before the shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.config import DEFAULT, Config
from veritome.functions import text as X
from veritome.operators.best import Best
from veritome.sources.tables import durable

#: A side of a join is only broadcast if it has at most so many rows by count.
BROADCAST_ROWS = 50_000
#: Dense queries of a block, and queries and vectors of a tile, whose scores are in memory at a time.
QUERIES, TILE = 10_000, (1000, 2000)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it is short; Spark's own choice of join beyond that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def top(df: DataFrame, k: int, by: list[Column], keys: list[str], rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where(F.col(rank) <= k)


def postings(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, text) -> (term, chunk_id, tf, dl)."""
    found = chunks.select("chunk_id", X.tokens(F.col("text")).alias("terms"))
    rows = found.select("chunk_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: the number of chunks and their mean length."""
    return chunks.select(F.size(X.tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))


def term_stats(posts: DataFrame, n_chunks: int, cfg: Config = DEFAULT) -> DataFrame:
    """(term, df, idf): negative idf is replaced by a share of the mean idf."""
    raw = posts.groupBy("term").agg(F.count("*").alias("df")).withColumn("raw", F.log(F.lit(n_chunks) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf")).first()["mean_idf"] or 0.0
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(cfg.epsilon * mean)).otherwise(F.col("raw")).alias("idf"))


def vocabulary(chunks: DataFrame) -> DataFrame:
    """(term, df, total): how many chunks have each term; under the null term the number of chunks and of all their tokens. One pass over the texts."""
    found = chunks.select(X.tokens(F.col("text")).alias("terms"))
    each = found.select(F.size("terms").alias("dl"), F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit(None).cast("string")))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total"))


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int | None = None, cfg: Config = DEFAULT, posts: DataFrame | None = None) -> DataFrame:
    """queries (query_id, question), chunks (chunk_id, text) -> (query_id, rank, chunk_id, score): Okapi BM25, ties by chunk_id, positive scores only.

    A repeated query term counts each time.  The texts are read twice: for the vocabulary, which is written to the shared folder, and for the tokens that
    are asked for, which alone leave the reader.  For many searches, write postings() once, by term, and give them as posts.
    """
    words = durable(vocabulary(chunks))
    size = words.where("term IS NULL").first()
    n_chunks, avgdl = (size["df"], (size["total"] or 0) / size["df"]) if size else (0, 0.0)
    raw = words.where("term IS NOT NULL").select("term", "df", (F.log(F.lit(n_chunks) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf")).first()["mean_idf"] or 0.0
    asked = queries.select("query_id", F.explode(X.tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = durable(asked.join(raw, "term").select("query_id", "term", "times", F.when(F.col("raw") < 0, F.lit(cfg.epsilon * mean)).otherwise(F.col("raw")).alias("idf")))
    if posts is None:
        rows = chunks.select("chunk_id", X.tokens(F.col("text")).alias("terms")).select("chunk_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
        posts = rows.join(small(wanted.select("term").distinct()), "term", "left_semi").groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    tf, dl = F.col("tf"), F.col("dl") / F.lit(avgdl or 1.0)
    weight = F.col("times") * F.col("idf") * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * dl))
    scored = posts.join(small(wanted), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), 6).alias("score")).where("score > 0")
    return top(scored, k or cfg.bm25_k, [F.desc("score"), F.col("chunk_id")], ["query_id"]).select("query_id", "rank", "chunk_id", "score")


def merged_search(base: DataFrame, session: DataFrame, k: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Two ranked lists as one, by raw score; of equal scores the base's come first."""
    both = base.withColumn("list_no", F.lit(1)).unionByName(session.withColumn("list_no", F.lit(2)))
    kept = top(both.withColumnRenamed("rank", "own"), k or cfg.bm25_k, [F.desc("score"), F.col("list_no"), F.col("own")], ["query_id"])
    return kept.select("query_id", "rank", "chunk_id", "score", "list_no")


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of unit length, those of length 0 and null ones as zeros, and which of them are null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.zeros((len(null), len(flat) // max(1, int((~null).sum()))))
    rows[~null] = flat.reshape(int((~null).sum()), -1)
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-300), null


class _Asked:
    """A block of queries: ids, unit vectors, which of them are null, and for each the number of its session's name."""

    def __init__(self, rows: pa.Table):
        self.ids, (self.vectors, self.null) = rows.column("query_id").combine_chunks(), _matrix(rows.column("vector").combine_chunks())
        self.near = self.vectors.astype(np.float32)
        names = rows.column("session").to_pylist() if "session" in rows.column_names else []
        self.codes = {"base": -1} | {s: i for i, s in enumerate(sorted(set(names) - {None, "base"}))}
        self.sessions = np.array([-2 if s is None else self.codes[s] for s in names])


def _scored(asked: _Asked, best: Best, ids: pa.Array, vectors: pa.Array, owners: pa.Array | None) -> None:
    """Adds the scores of these vectors to the best ones; a null vector, on either side, comes after all others."""
    (units, null), k = _matrix(vectors), best.k
    codes = np.array([asked.codes.get(o, -3) for o in owners.to_pylist()]) if owners is not None else None  # a null owner is nobody's
    near, error = units.astype(np.float32), 2e-6 + 1.2e-7 * (units.shape[1] + 2)  # scores in single precision tell which pairs are scored in double precision
    for start in range(0, len(units), TILE[1]):
        to = min(start + TILE[1], len(units))
        for at in range(0, len(asked.ids), TILE[0]):
            own = slice(at, min(at + TILE[0], len(asked.ids)))
            scores = asked.near[own] @ near[start:to].T
            scores[asked.null[own]] = -np.inf
            scores[:, null[start:to]] = -np.inf
            floor = best.floor[own].copy()
            new = np.flatnonzero(np.isneginf(floor))
            if to - start > k and len(new):  # no floor yet: the k-th of this tile is one, if so many are seen
                if codes is not None:
                    scores[(codes[start:to] != -1)[None] & (asked.sessions[own][:, None] != codes[start:to][None])] = -np.inf
                floor[new] = np.partition(scores[new], -k, 1)[:, -k]
            q, v = np.nonzero(scores >= (floor - error).astype(np.float32)[:, None])
            if codes is not None:
                seen = (codes[start:to][v] == -1) | (asked.sessions[own][q] == codes[start:to][v])
                q, v = q[seen], v[seen]
            exact = np.einsum("ij,ij->i", asked.vectors[own][q], units[start:to][v]) * 1e6
            exact[asked.null[own][q] | null[start:to][v]] = -np.inf
            best.add(q + at, np.sign(exact) * np.floor(np.abs(exact) + 0.5) / 1e6 + 0.0, ids.take(pa.array(v + start)))
        if best.size >= 1.3 * k * len(asked.ids):  # raises the floors
            best.cut()


def dense_search(queries: DataFrame, vectors: DataFrame, k: int | None = None, cfg: Config = DEFAULT, owners: bool = False) -> DataFrame:
    """queries (query_id, vector[, session]), vectors (chunk_id, vector[, owner]) -> (query_id, rank, chunk_id, score), by exact cosine, ties by chunk_id.

    Queries are a stated set against all vectors, broadcast in blocks of QUERIES; a task multiplies its vectors with a block as matrices, tile by tile, scores what may be among the best in double precision,
    and passes on at most k rows a query.  With owners, a query sees the base and its own session, and the filter comes before the ranking.  A null vector has a null score, which comes last; one of length 0 a score of 0.
    """
    k, spark = k or cfg.dense_k, queries.sparkSession
    asked = queries.select("query_id", "vector", *(["session"] if owners else []))
    # few files can mean few tasks, and the work of a row is that of all queries
    held = vectors.select("chunk_id", "vector", *(["owner"] if owners else [])).repartition(max(spark.sparkContext.defaultParallelism, vectors.rdd.getNumPartitions()))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"
    blocks, found = -(-asked.count() // QUERIES), []
    for i in range(blocks):
        rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).toArrow()
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast(_Asked(rows))

        def search(batches, shared=shared):
            best = Best(k, len(shared.value.ids))
            for batch in batches:
                _scored(shared.value, best, batch.column(0), batch.column(1), batch.column(2) if owners else None)
            kept = best.cut()
            if kept:
                yield pa.RecordBatch.from_arrays([shared.value.ids.take(pa.array(kept[0])), kept[2], pa.array(kept[1], mask=np.isneginf(kept[1]))], names=["query_id", "chunk_id", "score"])

        found.append(held.mapInArrow(search, kinds))
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kinds)
    return top(every, k, [F.desc("score"), F.col("chunk_id")], ["query_id"]).select("query_id", "rank", "chunk_id", "score")


def fused(lists: DataFrame, top_n: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """lists (query_id, list_no, rank, chunk_id) -> (query_id, rank, chunk_id, score): reciprocal ranks added; of equal sums the first seen comes first."""
    sums = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (cfg.rrf_k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    ranked = sums.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "seen")))
    return (ranked.where(F.col("rank") <= top_n) if top_n else ranked).select("query_id", "rank", "chunk_id", "score")


def looked_up(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of these ids (chunk_id); ids that aren't there drop out."""
    return ids.join(chunks, "chunk_id")


def overlap_scorer(question: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: a sigmoid of how much of the question the text covers."""
    return 1 / (1 + F.exp(-(8 * X.overlap(question, text) - 4)))


def ordinal_scores(candidates: DataFrame) -> DataFrame:
    """The ablation without a reranker: 1.0 for the first, 0.05 less for each after it."""
    return candidates.withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - 0.05 * (F.col("rank") - 1)), 4))


def reranked(candidates: DataFrame, scorer=overlap_scorer, cfg: Config = DEFAULT) -> DataFrame:
    """candidates (query_id, rank, chunk_id, question, text) -> all of them by the scorer's score, of 4 digits; ties keep the order."""
    scored = candidates.withColumn("score", F.round(scorer(F.col("question"), F.left("text", F.lit(cfg.rerank_chars))), 4)).withColumnRenamed("rank", "before")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "before"))).drop("before")


def retrieved(queries: DataFrame, chunks: DataFrame, ranked_lists: DataFrame, *, scorer=overlap_scorer, top_n: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Fusion, lookup (missing ids drop out), reranking and the cut, for every query with a question:
    (query_id, question, chunks, top_score, dense_hits, bm25_hits, fused_candidates, score_distribution)."""
    asked = queries.where(X.stripped(F.coalesce("question", F.lit(""))) != "").select("query_id", "question")
    found = fused(ranked_lists, cfg=cfg).select("query_id", "rank", "chunk_id").join(chunks, "chunk_id").join(asked, "query_id")
    ranked = reranked(found, scorer, cfg) if scorer else ordinal_scores(found)
    entry = F.struct("rank", "chunk_id", "score", "text", *(c for c in ("spec_id", "version", "clause_id", "clause_title") if c in chunks.columns))
    n = top_n or cfg.top_n
    summary = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(F.col("rank") <= n, entry))).alias("chunks"), F.max(F.when(F.col("rank") <= n, F.col("score"))).alias("top_score"), F.count("*").alias("fused_candidates"), F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", "score")))), lambda s: s["score"]).alias("score_distribution"))
    hits = ranked_lists.groupBy("query_id").agg(F.count_if(F.col("list_no") == 1).alias("dense_hits"), F.count_if(F.col("list_no") == 2).alias("bm25_hits"))
    out = asked.join(summary, "query_id", "left").join(hits, "query_id", "left")
    return out.select("query_id", "question", "chunks", F.coalesce("top_score", F.lit(0.0)).alias("top_score"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dense_hits", "bm25_hits", "fused_candidates")), "score_distribution")


def gated(results: DataFrame, tau: float | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Adds confidence, the rounded top score (0 without chunks), and answerable, whether it reaches the threshold."""
    none = F.coalesce(F.size("chunks"), F.lit(0)) <= 0
    return results.withColumn("confidence", F.when(none, F.lit(0.0)).otherwise(F.round("top_score", 4))).withColumn("answerable", F.col("confidence") >= F.lit(cfg.tau if tau is None else tau))


def abstention_message(reason: Column) -> Column:
    return F.when(reason.contains("timeout"), "The answer took too long; please try again.").otherwise("The indexed documents don't support an answer to this.")

"""Quality classification by votes of labelled nearest neighbours in a latent-semantic space.

The terms of a text are hashed trigrams of character shapes, and two for words: one that follows itself, and one that the text had before.
Their weights are log(1 + count) times the inverse document frequency, counted over all documents.  A truncated singular
value decomposition of the labelled sample gives the latent space.  The labelled vectors are broadcast (about 2 * `sample` rows of
`LATENT` numbers, whatever the corpus), and every document has its cosine with each of them computed exactly, in blocks; its `neighbours` nearest vote with
their label, weighted by a power of the similarity.

Cases: null and blank texts score 0; without labelled rows of both kinds all other texts score 0.5; null labels are not learnt from; ties among
neighbours go to the earlier labelled row; repeated rows are kept; further columns are kept by `score`, but for those named as its results, which are replaced; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.llm.features import collected, sampled, shape_trigrams, unit
from veritome.llm.runtime import quoted
from veritome.llm.text import pieces, words_of

SAMPLE = 1500
LATENT = 48
NEIGHBOURS = 25
_BITS = 10
TERMS = (1 << _BITS) + 2


def term_counts(texts: pa.Array) -> np.ndarray:
    words = words_of(texts, True)
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    out[:, :-2] = shape_trigrams(texts, _BITS)
    follows = np.zeros(len(words.hash) + 1, dtype=np.int64)
    follows[2:] = np.cumsum(words.hash[1:] == words.hash[:-1])[: max(0, len(words.hash) - 1)]
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b > a:
            out[i, -2] = follows[b] - follows[a + 1]
            out[i, -1] = b - a - len(np.unique(words.hash[a:b]))
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of each term over all documents, and the number of documents that have a text."""

    def count(batches):
        total, n = np.zeros(TERMS, dtype=np.int64), 0
        for piece in pieces(batches, "text", 2 << 20):
            rows = term_counts(piece.column(0))
            total += (rows > 0).sum(0)
            n += int((rows.any(1)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.r_[total, n])], names=["term", "df"])

    out = np.zeros(TERMS + 1, dtype=np.int64)
    for term, df in docs.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out[:-1], int(out[-1])


@dataclass
class NeighbourModel:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(np.log1p(counts) * self.idf) @ self.axes)

    def scores(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        out, k = np.empty(len(counts)), min(self.neighbours, len(self.labels))
        for at in range(0, len(counts), block):
            cosine = self.latent(counts[at : at + block]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(cosine, near, 1).min(1, keepdims=True)
            tied = np.flatnonzero((cosine >= least).sum(1) > k)
            near[tied] = np.argsort(-cosine[tied], axis=1, kind="stable")[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** 8
            out[at : at + block] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> NeighbourModel | None:
    """docs (doc_id, text) are all documents; labels (doc_id, label) those to be learnt from, 0 or 1."""
    chosen = sampled(labels.where("label IS NOT NULL"), "label", F.col("doc_id"), sample, 2)
    known = docs.join(F.broadcast(chosen.select("doc_id", F.col("label").cast("int").alias("label"))), "doc_id").where("text IS NOT NULL").select("label", "text")
    y, counts = collected(known, term_counts, "int")
    y = np.array(y, dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return None
    df, n = document_frequencies(docs)
    idf = (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)
    x = unit(np.log1p(counts) * idf)
    values, axes = np.linalg.eigh(x.T @ x)
    model = NeighbourModel(idf, axes[:, np.argsort(-values)[:LATENT]].astype(np.float32), np.zeros(0), y, neighbours)
    model.vectors = model.latent(counts).astype(np.float32)
    return model


def score(docs: DataFrame, model: NeighbourModel | None) -> DataFrame:
    """docs (any, text) -> all columns but text, with score and predicted."""
    kept = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    plain = [f"c{i}" for i in range(len(kept))]
    kinds = T.StructType([*(T.StructField(p, docs.schema[c].dataType) for c, p in zip(kept, plain, strict=True)), *T._parse_datatype_string("score double, predicted int")])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches):
        for piece in pieces(batches, "text", 2 << 20):
            counts = term_counts(piece.column(len(kept)))
            blank = words_of(piece.column(len(kept)), True).counts() == 0
            value = np.full(len(counts), 0.5) if shared.value is None else shared.value.scores(counts)
            value = np.clip(np.where(blank, 0.0, value), 0, 1)
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=kinds.names)

    rows = docs.select(*(quoted(c).alias(p) for c, p in zip(kept, plain, strict=True)), "text")
    return rows.mapInArrow(vote, kinds).toDF(*kept, "score", "predicted")


def op3_neighbour_quality(spark, sf_dir):
    from veritome.llm.language import bucket
    from veritome.llm.runtime import table

    docs, part = table(spark, sf_dir, "documents"), bucket(F.col("doc_id"), 3)
    labels = table(spark, sf_dir, "labels").where(part != 1).select("doc_id", F.col("quality").alias("label"))
    return score(docs.select("doc_id", (part == 1).alias("held_out"), "text"), fit(docs.select("doc_id", "text"), labels))

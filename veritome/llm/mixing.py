"""Soft-membership mixing: document rates whose expected token totals by domain match targets.

A classifier that learns from the labelled table gives each document a posterior over domains: logistic models of
hashed character shapes and words, on about `sample` rows of each domain, weighted back to the domains' shares.  With t tokens and posterior p, a document
kept at rate r adds r * t * p[k] expected tokens to domain k.  The rates start equal and minimise the squared misses of the
targets, weighted by the inverse of the domains' own sizes, over all r >= 0 by projected gradient steps with momentum, in the metric of the tokens, where the step is 1 / the largest
eigenvalue of a domains x domains matrix.  A step needs the domains' totals, one sum over all documents, added up by tasks of ROWS documents, each of which passes on a few numbers; the rates aren't stored in between but
replayed from the last REPLAY steps' gradients, a few numbers each, before which they are written to the shared folder; so a step's work doesn't grow with the steps before it, and lost tasks are
simply run again.  Momentum starts anew whenever the misses grow. Steps end when all targets are met within CLOSE, which `converged` tells, or the misses no longer fall.

Cases: null and blank texts have no tokens and rate 0; without labels every document is of one domain; a domain that has a target but no label is in no document (posterior 0), and its share goes to the other targets in proportion, so that the budget stays; repeated rows are kept; further
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.llm.features import collected, logistic, sampled, shape_trigrams, unit
from veritome.llm.runtime import durable
from veritome.llm.text import U64, Words, pieces, words_of

SAMPLE = 1500
STEPS, REPLAY = 80, 16
#: So many documents are a step's task: what is left of a document is about 60 bytes, and a step is a job, whose tasks the driver keeps account of.
ROWS = 50_000
CLOSE = 1e-5
#: Steps end where the last so many of them have lowered the misses by less than this share: the targets can't be met any better.
STILL, SHARE = 8, 1e-3
_WORD_BITS = 11
#: Shares of the tokens by domain, and how many tokens for each of the corpus.
TARGETS = {"clean": 0.90, "toxic": 0.06, "low": 0.04}
BUDGET = 0.5


def _features(texts: pa.Array, words: Words | None = None) -> np.ndarray:
    words = words or words_of(texts, True)
    terms = np.zeros((len(texts), 1 << _WORD_BITS), dtype=np.float32)
    at = (words.hash >> U64(64 - _WORD_BITS)).astype(np.int64)
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b > a:
            terms[i] = np.bincount(at[a:b], minlength=1 << _WORD_BITS)
    return np.concatenate([unit(np.sqrt(shape_trigrams(texts))), unit(np.sqrt(terms))], 1)


def posteriors(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> tuple[list[str], DataFrame]:
    """docs (doc_id, text), labels (doc_id, domain) -> the domains, and (doc_id, n_tokens, posterior array) of all documents."""
    known = labels.where("domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    domains, model = sorted(counts) or ["all"], None
    if len(domains) > 1:
        chosen = sampled(known, "domain", F.col("doc_id"), sample)
        y, x = collected(docs.join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL").select(F.col("domain").alias("label"), "text"), _features, "string")
        if len(y):
            at = np.array([domains.index(v) for v in y])
            size = np.bincount(at, minlength=len(domains))
            share = np.array([counts[d] for d in domains]) / np.maximum(size, 1)
            model = logistic(x, np.eye(len(domains), dtype=np.float32)[at], np.repeat(share[at][:, None], len(domains), 1), 200)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(domains)

    def predict(batches):
        for piece in pieces(batches, "text", 2 << 20):
            words = words_of(piece.column(1), True)
            if shared.value is None:
                p = np.full((piece.num_rows, k), 1 / k)
            else:
                w, b = shared.value
                p = 1 / (1 + np.exp(-np.clip((_features(piece.column(1), words) @ w + b).astype(np.float64), -30, 30)))
                p /= p.sum(1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(words.counts()), lists], names=["doc_id", "n_tokens", "posterior"])

    return domains, docs.mapInArrow(predict, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, posterior array<double>")


def replayed(p: np.ndarray, rate: np.ndarray, ahead: np.ndarray, slopes: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """The rates, and the point from which the next step goes, after the steps with these gradients and momenta."""
    for slope, momentum in slopes:
        new = np.maximum(0.0, ahead - p @ slope)
        rate, ahead = new, new + momentum * (new - rate)
    return rate, ahead


def _posterior(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("posterior")).flatten().to_numpy().reshape(-1, k)


def _sums(members: DataFrame, make, n: int) -> np.ndarray:
    """The sum over all batches of make(batch), a vector of n numbers; a task passes on one such vector."""

    def add(batches):
        total = np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"s{i}" for i in range(n)])

    got = members.mapInArrow(add, ", ".join(f"s{i} double" for i in range(n))).collect()
    return np.array(got, dtype=np.float64).reshape(-1, n).sum(0)


def target_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *, budget: float = BUDGET, steps: int = STEPS, close: float = CLOSE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, labels (doc_id, domain) -> (doc_id, n_tokens, p_<domain> .., rate, converged); targets are shares of budget * all tokens."""
    domains, members = posteriors(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels)
    k, missing = len(domains), sorted(d for d in targets if d not in domains)
    members = durable(members.withColumn("rate", F.lit(float(budget))).withColumn("ahead", F.lit(float(budget))))
    if domains == ["all"]:
        targets = {"all": sum(targets.values())}
    met = sum(targets.get(d, 0.0) for d in domains)
    if met <= 0 < sum(targets.values()):
        raise ValueError(f"no label names a domain of the targets {sorted(targets)}; the labels' are {domains}")
    grown = sum(targets.values()) / met if met > 0 else 1.0

    def moments(batch):
        p, t = _posterior(batch, k), batch.column(1).to_numpy().astype(np.float64)
        return np.r_[len(t), t.sum(), ((p * t[:, None]).T @ p).ravel()]

    sums = _sums(members, moments, 2 + k * k)
    tokens, gram = sums[1], sums[2:].reshape(k, k)
    tasks = max(1, math.ceil(sums[0] / ROWS))
    if tasks < members.rdd.getNumPartitions():
        members = durable(members.coalesce(tasks))
    weight = 1 / np.maximum(np.diag(gram), max(0.01 * np.trace(gram), 1e-12))  # rare domains weigh more, up to a bound
    step = 1 / max(np.linalg.eigvalsh(np.sqrt(weight)[:, None] * gram * np.sqrt(weight)).max(), 1e-12)
    wanted = np.array([targets.get(d, 0.0) for d in domains]) * grown * tokens * budget
    slopes: list[tuple[np.ndarray, float]] = []
    costs, since, converged = [], 0, not tokens
    kind = f"doc_id {members.schema['doc_id'].dataType.simpleString()}, n_tokens long"

    def point(batch):
        column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy()
        p = _posterior(batch, k)
        return p, column("n_tokens").astype(np.float64), *replayed(p, column("rate"), column("ahead"), slopes)

    def totals(batch):
        p, t, rate, ahead = point(batch)
        return np.r_[(t * rate) @ p, (t * ahead) @ p]

    def stepped(batches):
        for batch in batches:
            _, _, rate, ahead = point(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rate), pa.array(ahead)], names=["doc_id", "n_tokens", "posterior", "rate", "ahead"])

    for _ in range(steps if tokens else 0):
        now = _sums(members, totals, 2 * k)
        converged = bool((np.abs(now[:k] - wanted) <= close * max(wanted.max(), 1.0)).all())
        costs.append(float((weight * (now[:k] - wanted) ** 2).sum()))
        if converged or (len(costs) > STILL and min(costs[-STILL:]) > (1 - SHARE) * min(costs[:-STILL])):
            break
        since = 0 if len(costs) > 1 and costs[-1] > costs[-2] else since + 1  # momentum that leads uphill is dropped
        if len(slopes) == REPLAY:
            members = durable(members.mapInArrow(stepped, f"{kind}, posterior array<double>, rate double, ahead double"))
            slopes = []
        slopes.append((step * weight * (now[k:] - wanted), since / (since + 3)))

    names = [*(f"p_{d}" for d in domains), *(f"p_{d}" for d in missing if domains != ["all"])]

    def final(batches):
        for batch in batches:
            p, t, rate, _ = point(batch)
            p = np.concatenate([p, np.zeros((len(p), len(names) - k))], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c)) for c in p.T), pa.array(np.where(t > 0, rate, 0.0)), pa.array(np.full(len(t), converged))], names=["doc_id", "n_tokens", *names, "rate", "converged"])

    return members.mapInArrow(final, f"{kind}, {''.join(f'`{c}` double, ' for c in names)}rate double, converged boolean")


def labelled_domains(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) -> (doc_id, domain): low quality, toxic, or clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").alias("domain"))


def op6_soft_mixing(spark, sf_dir):
    from veritome.llm.runtime import table

    return target_rates(table(spark, sf_dir, "documents"), labelled_domains(table(spark, sf_dir, "labels")), TARGETS)

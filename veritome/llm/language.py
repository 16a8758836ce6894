"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1.  For each bit a binary classifier over hashed letter trigrams learns to tell the
languages that have +1 there from those that have -1.  A text goes to the language whose codeword has the least loss,
the sum over bits of the bit's weight times log(1 + exp(-bit * margin)); the weight of a bit is its accuracy above chance
on a quarter of the sample that it did not learn from (loss-weighted decoding).  Where the second language comes close, the text is flagged as ambiguous.

Up to seven languages have all 2 ** (L - 1) - 1 distinct splits; more have 10 * log2(L) random bits, from the draw with the widest
least distance.  The classifiers learn from about `sample` rows of each language, chosen by the hash of the id;
texts are predicted whole.  Languages beyond the LABELS most frequent, and rows beyond SAMPLED in all (features.py), aren't learnt from.

Cases: null texts, and those without a letter, are `und` with score 0; without a labelled row all are; rows without a label are predicted
but not learnt from; repeated rows are kept; further columns are kept by `predict`, but for those named as its results, which are replaced; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.llm.features import collected, letter_trigrams, logistic, sampled, unit
from veritome.llm.runtime import quoted
from veritome.llm.text import pieces

SAMPLE = 800
CLOSE = 0.2


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +1 and -1."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        splits = [[1 if i in own else -1 for i in range(n)] for k in range(1, n) for own in combinations(range(n), k) if 0 in own]
        return np.array(splits, np.float32).T
    random, best, widest = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = random.choice(np.array([-1, 1], np.float32), (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = ((code.shape[1] - code @ code.T) / 2)[np.triu_indices(n, 1)].min()
        if apart > widest:
            best, widest = code, apart
    return best


def _features(texts: pa.Array) -> np.ndarray:
    return unit(np.sqrt(letter_trigrams(texts)))


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    bit_weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """For each row the share of each language, which adds up to 1."""
        margin = features @ self.weights + self.intercepts
        loss = np.stack([np.logaddexp(0, -margin * word) @ self.bit_weights for word in self.code], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        return share / share.sum(1, keepdims=True)


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """docs (doc_id, text, lang), all of them to be learnt from."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    labels, x = collected(sampled(known, "lang", F.col("doc_id"), sample).select("lang", "text"), _features, "string")
    if not labels:
        return None
    languages = sorted(set(labels))
    at = np.array([languages.index(v) for v in labels])
    code = codewords(len(languages))
    y, held = (code[at] > 0).astype(np.float32), np.arange(len(at)) % 4 == 3
    size = np.bincount(at, minlength=len(languages))
    weight = np.repeat((1 / size[at])[:, None], code.shape[1], 1)
    if held.sum() < 4 * len(languages):
        held[:] = False
    w, b = logistic(x[~held], y[~held], weight[~held])
    check = held if held.any() else ~held
    right = ((x[check] @ w + b > 0) == (y[check] > 0)).mean(0)
    bits = np.maximum(right - 0.5, 0.01)
    return LanguageModel(languages, code, w, b, (bits / bits.sum() * len(bits)).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel | None, close: float = CLOSE) -> DataFrame:
    """docs (doc_id, text, then any) -> all but text, with lang_pred, score and ambiguous."""
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "ambiguous")]
    plain = [f"c{i}" for i in range(len(kept))]
    kinds = T.StructType([*(T.StructField(p, docs.schema[c].dataType) for c, p in zip(kept, plain, strict=True)), *T._parse_datatype_string("lang_pred string, score double, ambiguous boolean")])
    rows = docs.select(*(quoted(c).alias(p) for c, p in zip(kept, plain, strict=True)), F.when(lettered, F.col("text")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decode(batches):
        model = shared.value
        for piece in pieces(batches, "text"):
            texts = piece.column(len(kept))
            known = ~texts.is_null().to_numpy(zero_copy_only=False) & (model is not None)
            name, score, ambiguous = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known.any():
                share = model.scores(_features(texts))
                best = share.argmax(1)
                top = np.sort(share, 1)
                name = np.where(known, np.array(model.languages, dtype=object)[best], name)
                score = np.where(known, top[:, -1].astype(np.float64), 0.0)
                ambiguous = known & (top[:, -1] - (top[:, -2] if top.shape[1] > 1 else 0) < close)
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], pa.array(name, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(ambiguous)], names=kinds.names)

    return rows.mapInArrow(decode, kinds).toDF(*kept, *kinds.names[len(kept) :])


def bucket(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo a number; of a null key, -1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % of, F.lit(-1))


def op2_language_codes(spark, sf_dir):
    from veritome.llm.runtime import table

    docs = table(spark, sf_dir, "documents")
    part = bucket(F.col("doc_id"), 5)
    model = fit(docs.where(part != 0).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", (part == 0).alias("held_out"), "text"), model)

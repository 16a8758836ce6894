"""Hashed n-gram counts of whole texts, and bounded labelled samples."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritome.llm.text import _buffers

_MULTIPLY = np.uint32(2654435761)
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_SHAPE = np.zeros(256, dtype=np.uint8)
_SHAPE[:128] = [6 + b % 58 for b in range(128)]
_SHAPE[[9, 11, 12, 13, 32]], _SHAPE[10] = 0, 1
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 2, 3, 4, 4


def _folded(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (ASCII, and those of two bytes that start with C3), all else in ASCII as blanks."""
    out = _LETTERS[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        out[1:][capital] += 0x20
    return out


def _grams(symbols: np.ndarray, bits: int) -> np.ndarray:
    """The hash, of so many bits, of the three symbols from each place on."""
    if len(symbols) < 3:
        return np.zeros(0, dtype=np.uint32)
    code = symbols.astype(np.uint32)
    code = (code[:-2] << np.uint32(16)) | (code[1:-1] << np.uint32(8)) | code[2:]
    return (code * _MULTIPLY) >> np.uint32(32 - bits)


def letter_trigrams(texts: pa.Array, bits: int = 11) -> np.ndarray:
    """A row of float32 counts for each text; null texts have none."""
    return _counted(texts, _folded, bits)


def shape_trigrams(texts: pa.Array, bits: int = 10) -> np.ndarray:
    """Like letter_trigrams, of the shapes of characters: blank, line end, digit, capital, other letter, and the rest by themselves."""
    return _counted(texts, lambda data: _SHAPE[data], bits)


def _counted(texts: pa.Array, symbols: Callable, bits: int) -> np.ndarray:
    data, offsets = _buffers(texts)
    grams, out = _grams(symbols(data), bits), np.zeros((len(texts), 1 << bits), dtype=np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a >= 3:
            out[i] = np.bincount(grams[a : b - 2], minlength=1 << bits)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-9)


#: A sample has at most so many rows, of at most so many labels.
SAMPLED, LABELS = 24_000, 1000


def sampled(df: DataFrame, label: str, key: Column, rows: int, labels: int = LABELS) -> DataFrame:
    """About `rows` rows of each of the `labels` most frequent values of the label, picked by the hash of the key, the same ones every time; fewer of each
    where there are so many labels that the sample would have more than SAMPLED rows.

    Were a key repeated very often, its rows could be picked together; in any case there are at most twice as many rows in all.
    """
    counts = df.groupBy(label).count().orderBy(F.desc("count"), label).limit(labels).collect()
    if not counts:
        return df.limit(0)
    rows = max(1, min(rows, SAMPLED // len(counts)))
    share = F.coalesce(*[F.when(F.col(label) == F.lit(r[0]), F.lit(min(1.0, rows / r[1]))) for r in counts], F.lit(0.0))
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_003)) < share * 1_000_003).limit(2 * rows * len(counts))


def collected(df: DataFrame, extract: Callable[[pa.Array], np.ndarray], kinds: str) -> tuple[list, np.ndarray]:
    """Labels and features of a bounded sample df (label, text), in an order that doesn't depend on partitions.

    A key of the sample that is repeated in the texts would bring all its rows; of more than twice SAMPLED rows the rest isn't learnt from.
    The driver gets the features that aren't 0, which are few, and their order from the tasks.
    """
    df = df.limit(2 * SAMPLED)

    def features(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = extract(batch.column(1)).astype(np.float32)
            digests = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in rows]
            places = [np.flatnonzero(r) for r in rows]
            columns = [digests, [p.astype(np.uint32).tobytes() for p in places], [r[p].tobytes() for r, p in zip(rows, places, strict=True)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in columns), pa.array(np.full(len(rows), rows.shape[1], np.int32))], names=["label", "digest", "places", "features", "width"])

    got = df.mapInArrow(features, f"label {kinds}, digest binary, places binary, features binary, width int").toArrow()
    labels, digests, places, rows = (got.column(c) for c in ("label", "digest", "places", "features"))
    labels, digests = labels.to_pylist(), digests.to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (labels[i], digests[i]))
    if not order:
        return [], np.zeros((0, 0), np.float32)
    out = np.zeros((len(order), got.column("width")[0].as_py()), np.float32)
    for i, j in enumerate(order):
        out[i, np.frombuffer(places[j].as_buffer(), np.uint32)] = np.frombuffer(rows[j].as_buffer(), np.float32)
    return [labels[j] for j in order], out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of a logistic model for each column of y (0 or 1), by accelerated gradient descent on all rows."""
    n, k = y.shape
    w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    v, c, step = w, b, 3.0
    weight = (weight / weight.sum(0)).astype(np.float32)
    for t in range(steps):
        slope = (1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y) * weight
        new_w, new_b = v - step * (x.T @ slope + ridge * v), c - step * slope.sum(0)
        v, c = new_w + t / (t + 3) * (new_w - w), new_b + t / (t + 3) * (new_b - b)
        w, b = new_w, new_b
    return w, b

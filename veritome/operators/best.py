"""The best rows of each query that a task has seen so far, and the score that a new one must reach."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Best:
    """At most k rows of each of n queries, by score and then by id; floor has the k-th score, or the least one asked for while there are fewer."""

    def __init__(self, k: int, n: int, least: float = -np.inf):
        self.k, self.floor, self.most, self.size = k, np.full(n, least), max(100_000, 4 * k * n), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        if len(query):
            self.parts.append((query, score, ids))
            self.size += len(query)
        if self.size > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        if not self.parts:
            return None
        query, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        ids = pa.chunked_array([p[2] for p in self.parts]).combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        _, place = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
        order = np.lexsort((place, -score, query))
        ordered = query[order]
        start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
        last = order[rank == self.k - 1]
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        keep = order[rank < self.k]
        self.parts, self.size = [(query[keep], score[keep], ids.take(pa.array(keep)))], len(keep)
        return self.parts[0]

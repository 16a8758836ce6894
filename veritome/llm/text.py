"""Words, shingles and their hashes for whole Arrow batches of texts.

A word is a maximal run of bytes other than the six ASCII blanks (space, \\t, \\n,
\\v, \\f, \\r), in UTF-8.  Each word gets a 64-bit hash, optionally after A-Z are lower-cased;
sequences of words are hashed from the hashes of their words.  Everything here works on
one Arrow batch at a time with numpy, without a Python object per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLANKS = (32, 9, 10, 11, 12, 13)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of more bytes than this are hashed one by one.
_LONG = 64
_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)
_STEP = U64(0x9E3779B97F4A7C15)
_SEQ = U64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that all bits depend on all bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@dataclass
class Words:
    """The words of a batch of texts. Word i is data[start[i]:end[i]]; text d has the words first[d]:first[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, lower: bool, blank: np.ndarray = _BLANK) -> Words:
    """Null texts have no words; blank tells which bytes separate them."""
    data, offsets = _buffers(texts)
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]]  # two texts touch here without a blank: a word ends and another starts
    at = np.flatnonzero(edge)
    at = np.sort(np.concatenate([at, cut, cut]), kind="stable") if len(cut) else at
    start, end = at[0::2], at[1::2]
    first = np.searchsorted(start, offsets).astype(np.int64)
    return Words(data, start, end, first, _hashes(data, start, end, lower))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Eight bytes at a time, each step scrambled before the next; long words by BLAKE2."""
    size = end - start
    out = mix(size.astype(U64))
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:-8] = _LOWER[data] if lower else data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    own = np.flatnonzero(size <= _LONG)
    for at in range(0, _LONG, 8):
        own = own[size[own] > at] if at or len(own) < len(size) else np.arange(len(size))
        if not len(own):
            break
        value = eights[start[own] + at] & _TAIL[np.minimum(size[own] - at, 8)]
        out[own] = mix((out[own] * _STEP) ^ value)
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Entry i: the hash of the n values from h[i] on; len(h) - n + 1 entries, computed by doubling."""
    if len(h) < n:
        return np.zeros(0, dtype=U64)
    power, size, piece, factor = h, 1, None, _SEQ
    done = 0
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                if piece is None:
                    piece, done = power, size
                else:
                    m = len(h) - done - size + 1
                    piece, done = piece[:m] * factor + power[done : done + m], done + size
            if size * 2 > n:
                break
            m = len(power) - size
            power = power[:m] * factor + power[size : size + m]
            factor, size = factor * factor, size * 2
    return mix(piece[: len(h) - n + 1])


def shingle_sets(words: Words, n: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of fewer words, one hash of the whole sequence; of none, nothing."""
    grams = sequence_hashes(words.hash, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield sequence_hashes(words.hash[a:b], b - a) + U64(b - a)
        else:
            yield np.zeros(0, dtype=U64)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each piece has at most so many rows, and its texts at most so many bytes (or is a single text)."""
    for batch in batches:
        _, offsets = _buffers(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = min(i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
            yield batch.slice(i, j - i)
            i = j


def _planes(values: np.ndarray) -> bytes:
    """First all lowest bytes, then all next ones, and so on: small numbers and sorted ones leave runs that compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def dealt(bucket: np.ndarray, columns: list, names: list[str], planes: bool = False) -> pa.RecordBatch:
    """One row for each bucket, with the bytes of its part of each column; a column with a mask, as a pair, has values only for the entries in the mask. With planes, bytes of one place stand together."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    stop = np.r_[start[1:], len(bucket)][: len(start)]
    out = [pa.array(bucket[start].astype(np.int32))]
    for column in columns:
        if isinstance(column, tuple):
            values, mask = column
            own = np.r_[0, np.cumsum(mask[order])]
            place = np.cumsum(mask) - 1
            values = values[place[order[mask[order]]]]
            cuts = zip(own[start].tolist(), own[stop].tolist(), strict=True)
        else:
            values, cuts = column[order], zip(start.tolist(), stop.tolist(), strict=True)
        out.append(pa.array([_planes(values[a:b]) if planes else values[a:b].tobytes() for a, b in cuts], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=["bucket", *names])


def gathered(table: pa.Table, name: str, dtype, planes: bool = False) -> np.ndarray:
    """All values of a column of dealt()."""
    size = np.dtype(dtype).itemsize
    read = (lambda b: np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype)[:, 0]) if planes else (lambda b: np.frombuffer(b, dtype))
    return np.concatenate([read(x.as_buffer()) for x in table.column(name)] or [np.zeros(0, dtype)])


def several(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    out = np.zeros(len(values), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out

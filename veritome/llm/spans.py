"""Substring dedup by relative Lempel-Ziv parsing: the words of every document that a repeated window covers.

A window is n consecutive words of a document; a window is repeated if its word sequence also starts anywhere else.

1. The index.  Comparing all windows would shuffle a hash for every word of the corpus, so the reference, which is the corpus itself, is indexed by anchors: the anchor of a
   window is its k-word sequence with the least hash, the leftmost one if there are several.  The same words have the same anchor at the same place,
   so a window can only be repeated if its anchor is, and windows share anchors, about 2 / (n - k + 2) for each word.  Anchors are dealt into blocks by hash; those that occur once are dropped.
2. The parse.  Each window with a repeated anchor goes to that anchor's block.  A block's windows, in the order of their texts, are indexed by a suffix array.  Each text is factored
   greedily against the block: from its first repeated window on, the factor is the longest run of words that also starts at another place of the block, the source, and is found beside it in the suffix array.
   At the factor's end the windows that cross its boundary are looked up themselves: the first that is repeated starts the next factor.  A factor has one source, and n words at least.
   A document is factored against every block that has one of its anchors, and against the batch of texts that it is read in.
3. Factors are duplicate spans.  Those of one document that go on along one source are joined (`factors`); all are merged and their words removed.

A sequence that a task has seen twice needs no comparison elsewhere, so only one occurrence of it is sent to its block: the text of a
large group of copies doesn't gather in one task.

Cases: null and blank texts have no words; texts of fewer than n words have no windows; repeated rows repeat each other's windows, name themselves as the source, and all are kept as rows; ids may be null;
further columns are kept where text is returned and ignored elsewhere; empty tables give empty results.  Equality is that of the 64-bit hashes of windows within a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.llm.runtime import blocks_of, durable, quoted
from veritome.llm.text import U64, Words, dealt, gathered, mix, pieces, sequence_hashes, several, words_of

WORDS = 35
_KNOWN = np.uint32(1 << 31)


def leftmost_minimum(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of the least one, the leftmost if several."""
    if len(values) < w:
        return np.zeros(0, dtype=np.int64)
    power, at, size, best, place, done = values, np.arange(len(values), dtype=np.int32), 1, None, None, 0

    def lesser(x, i, y, j, m):
        right = y[:m] < x[:m]
        return np.where(right, y[:m], x[:m]), np.where(right, j[:m], i[:m])

    while True:
        if w & size:
            if best is None:
                best, place, done = power, at, size
            else:
                best, place = lesser(best, place, power[done:], at[done:], len(values) - done - size + 1)
                done += size
        if size * 2 > w:
            break
        power, at = lesser(power, at, power[size:], at[size:], len(values) - 2 * size + 1)
        size *= 2
    return place[: len(values) - w + 1].astype(np.int64)


class Anchors:
    """The windows of a batch of texts, in order, and the anchor of each; places are word numbers in the batch."""

    def __init__(self, words: Words, n: int):
        self.k = max(1, n // 3)
        self.grams = sequence_hashes(words.hash, self.k)
        place = leftmost_minimum(self.grams, n - self.k + 1)
        counts = words.counts()
        text = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
        skip = np.cumsum(np.r_[0, np.maximum(counts - n + 1, 0)])[:-1]
        self.window = words.first[text] + np.arange(len(text)) - skip[text]
        self.place, self.text = place[self.window], text
        self.start = np.flatnonzero(np.r_[True, (self.place[1:] != self.place[:-1]) | (text[1:] != text[:-1])]) if len(text) else np.zeros(0, np.int64)


def _first_of_each(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), dtype=bool)
    out[np.unique(values, return_index=True)[1]] = True
    return out


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(doc_id, text).alias("row"), *docs.columns).withColumnRenamed(text, "text")


def repeated_anchors(texts: DataFrame, n: int) -> DataFrame:
    """texts (row, text) -> (row, places): word numbers, in the text, of anchors that occur again somewhere; several rows for a text."""
    count = blocks_of(texts)

    def anchors(batches):
        for piece in pieces(batches, "text"):
            words = words_of(piece.column(1), False)
            own = Anchors(words, n)
            if not len(own.start):
                continue
            text = own.text[own.start]
            hashes, row = own.grams[own.place[own.start]], piece.column(0).to_numpy().view(U64)[text]
            place = (own.place[own.start] - words.first[text]).astype(np.uint32)
            known = several(hashes)
            sent = ~known | _first_of_each(hashes)
            bucket = np.where(sent, hashes, mix(row.copy())) % U64(count)
            yield dealt(bucket, [hashes, row, place | np.where(known, _KNOWN, np.uint32(0)), sent.astype(np.uint8)], ["hashes", "rows", "places", "sent"])

    def meet(table):
        hashes, row, place, sent = (gathered(table, c, t) for c, t in (("hashes", U64), ("rows", U64), ("places", np.uint32), ("sent", np.uint8)))
        known, again = (place & _KNOWN) > 0, np.zeros(len(place), bool)
        at = np.flatnonzero(sent)
        again[at] = several(hashes[at])
        # an anchor that a task knows to be repeated makes its other occurrences repeated too: those tasks sent it alone
        keep = np.flatnonzero(known | again)
        row, place = row[keep], place[keep] & ~_KNOWN
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        once = np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1])][: len(row)]  # equal rows have their places once
        row, place = row[once], place[once]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        stop = np.r_[start[1:], len(row)][: len(start)]
        return pa.table({"row": pa.array(row[start].view(np.int64)), "places": pa.array([place[a:b].tobytes() for a, b in zip(start, stop, strict=True)], pa.binary())})

    sorted_out = texts.select("row", "text").mapInArrow(anchors, "bucket int, hashes binary, rows binary, places binary, sent binary")
    return sorted_out.groupBy("bucket").applyInArrow(meet, "row long, places binary")


def longest_matches(symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest sequence that starts at another place too, and that place.

    symbols are those of several texts in a row, and left[i] is how many remain of i's text, its own included.  The suffix array is made by doubling;
    of the suffixes, one of the two neighbours has the longest common part with each.
    """
    m, size = len(symbols), 1
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    ranks, at = [rank], np.arange(m)
    while size < left.max(initial=0):
        more = left > size
        after = np.zeros(m, dtype=np.int64)
        after[more] = rank[at[more] + size] + 1
        rank = np.unique(rank * (m + 1) + after, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        size *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        fits = np.flatnonzero((left[a] - common >= 1 << k) & (left[b] - common >= 1 << k))
        same = fits[ranks[k][a[fits] + common[fits]] == ranks[k][b[fits] + common[fits]]]
        common[same] += 1 << k
    length, source = np.zeros(m, dtype=np.int64), at.copy()
    length[b], source[b] = common, a
    better = common > length[a]
    length[a[better]], source[a[better]] = common[better], b[better]
    return length, source


def greedy_factors(value: np.ndarray, row: np.ndarray, start: np.ndarray, n: int) -> list[np.ndarray]:
    """Windows of a block, by hash, text and place -> the factors of its texts relative to the block: row, start, stop, source_row, source_start.

    All windows given are repeated in the block.  Where equal rows have a window at one place, its source may be that place of the other row, so itself.
    """
    order = np.lexsort((start, row))
    value, row, start = value[order], row[order], start[order].astype(np.int64)
    first = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1])][: len(row)]
    times = np.diff(np.r_[np.flatnonzero(first), len(row)])
    value, row, start = value[first], row[first], start[first]
    m = len(row)
    if not m:
        return [np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, U64), np.zeros(0, np.uint32)]
    goes_on = np.r_[(row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1), False]
    left = _run_lengths(goes_on)
    length, source = longest_matches(value, left)
    again = np.where(times > 1, _run_lengths(goes_on & np.r_[(times > 1)[1:], False]), 0)
    own = again > length
    length, source = np.where(own, again, length), np.where(own, np.arange(m), source)
    at, i, steps = [], 0, length.tolist()
    while i < m:  # the window after a factor's last one crosses its boundary and is looked up itself
        at.append(i)
        i += steps[i]
    at = np.array(at)
    return [row[at], start[at].astype(np.uint32), (start[at] + length[at] + n - 1).astype(np.uint32), row[source[at]], start[source[at]].astype(np.uint32)]


def _run_lengths(goes_on: np.ndarray) -> np.ndarray:
    """How many places there are from each on to the first that doesn't go on, which counts."""
    stops = np.flatnonzero(~goes_on)
    at = np.arange(len(goes_on))
    return stops[np.searchsorted(stops, at)] - at + 1


_WINDOW = {"hashes": U64, "rows": U64, "starts": np.uint32}
_FACTOR = {"factor_rows": U64, "factor_starts": np.uint32, "factor_stops": np.uint32, "source_rows": U64, "source_starts": np.uint32}


def block_factors(texts: DataFrame, n: int) -> DataFrame:
    """texts (row, .., text) -> (row, start, stop, source_row, source_start): the factors of every text relative to each block."""
    count = blocks_of(texts)
    found = durable(repeated_anchors(texts, n)).groupBy("row").agg(F.collect_list("places").alias("places"))
    kept = [c for c in texts.columns if c not in ("row", "text")]  # they come along, so that the texts are shuffled once for this join and for that with the spans
    joined = texts.select("row", *kept, "text").join(found, "row").select("row", *kept, "text", "places")

    def windows(batches):
        for piece in pieces(batches, "text"):
            texts, lists = piece.column(len(kept) + 1), piece.column(len(kept) + 2)
            words = words_of(texts, False)
            own, hashes = Anchors(words, n), sequence_hashes(words.hash, n)
            marked = np.zeros(len(words.hash) + 1, dtype=bool)
            for first, places in zip(words.first[:-1].tolist(), lists, strict=True):
                for x in places.values:
                    marked[first + np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64)] = True
            chosen = marked[own.place]
            window, text, place = own.window[chosen], own.text[chosen], own.place[chosen]
            if not len(window):
                continue
            value, row = hashes[window], piece.column(0).to_numpy().view(U64)[text]
            start = (window - words.first[text]).astype(np.uint32)
            hot = several(value)
            # what occurs again among these very texts is factored here, and only its first occurrence is sent on
            here = greedy_factors(value[hot], row[hot], start[hot], n)
            sent = ~hot | _first_of_each(value)
            bucket = np.r_[own.grams[place[sent]] % U64(count), mix(here[0].copy()) % U64(count)]
            done = np.arange(len(bucket)) >= int(sent.sum())
            yield dealt(bucket, [*((c[sent], ~done) for c in (value, row, start)), *((c, done) for c in here)], [*_WINDOW, *_FACTOR])

    def parse(table):
        value, row, start = (gathered(table, c, t) for c, t in _WINDOW.items())
        again = several(value)
        columns = [np.concatenate(c) for c in zip(greedy_factors(value[again], row[again], start[again], n), [gathered(table, c, t) for c, t in _FACTOR.items()], strict=True)]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        once = np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)][: len(order)]
        return pa.table({name: pa.array(c[once].view(np.int64) if c.dtype == U64 else c[once].astype(np.int64)) for name, c in zip(("row", "start", "stop", "source_row", "source_start"), columns, strict=True)})

    binaries = ", ".join(f"{c} binary" for c in (*_WINDOW, *_FACTOR))
    return joined.mapInArrow(windows, f"bucket int, {binaries}").groupBy("bucket").applyInArrow(parse, "row long, start long, stop long, source_row long, source_start long")


def factors(texts: DataFrame, n: int = WORDS) -> DataFrame:
    """texts (row, text) -> (row, start, stop, source_row, source_start): words start to stop - 1 of the text are those from word source_start on of the text source_row.

    Factors that several blocks found along one source, and that meet or overlap, are one.
    """
    along = W.partitionBy("row", "source_row", "shift").orderBy("start", "stop")
    found = block_factors(texts, n).withColumn("shift", F.col("start") - F.col("source_start"))
    reached = F.max("stop").over(along.rowsBetween(W.unboundedPreceding, -1))
    parts = found.withColumn("new", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return parts.groupBy("row", "source_row", "shift", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("row", "start", "stop", "source_row", (F.col("start") - F.col("shift")).alias("source_start"))


def _removed(words: Words, starts: pa.Array, stops: pa.Array) -> np.ndarray:
    """Which words of the batch the spans of its texts cover."""
    step = np.zeros(len(words.hash) + 1, dtype=np.int32)
    for first, a, b in zip(words.first[:-1].tolist(), starts, stops, strict=True):
        if a.is_valid:
            np.add.at(step, first + a.values.to_numpy(zero_copy_only=False), 1)
            np.add.at(step, first + b.values.to_numpy(zero_copy_only=False), -1)
    return np.cumsum(step[:-1]) > 0


def _with_spans(texts: DataFrame, n: int) -> DataFrame:
    spans = block_factors(texts, n).groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    kept = [c for c in texts.columns if c not in ("row", "text")]
    return texts.select("row", *kept, "text").join(spans, "row", "left").select(*kept, "text", "starts", "stops")


def dedup_digest(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): the digest is of the kept words, joined by one space."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def digest(batches):
        for piece in pieces(batches, "text"):
            words = words_of(piece.column(1), False)
            gone = _removed(words, piece.column(2), piece.column(3))
            removed = np.diff(np.r_[0, np.cumsum(gone)][words.first])
            digests = []
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                kept = words.data[words.start[a] : words.end[b - 1]].tobytes().split() if b > a else []
                if removed[i]:
                    kept = [w for w, g in zip(kept, gone[a:b].tolist(), strict=True) if not g]
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(words.counts()), pa.array(removed), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_spans(_texts(own, "doc_id", "text"), n).mapInArrow(digest, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """docs with the covered words, and the blanks after them, cut from the texts; all rows and columns stay."""
    kept = [c for c in docs.columns if c != text]
    plain = [f"c{i}" for i in range(len(kept))]
    own = docs.select(*(quoted(c).alias(p) for c, p in zip(kept, plain, strict=True)), quoted(text).alias("text"))

    def cut(batches):
        for piece in pieces(batches, "text"):
            texts = piece.column(len(plain))
            words = words_of(texts, False)
            gone, out = _removed(words, piece.column(len(plain) + 1), piece.column(len(plain) + 2)), texts.to_pylist()
            ends = np.r_[words.start[1:], len(words.data)]
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                if b > a and (own := gone[a:b]).any():
                    stop = ends[a:b].copy()
                    stop[-1] = words.end[b - 1]
                    left = np.flatnonzero(~own)
                    out[i] = b"".join(words.data[words.start[a + x] : stop[x]].tobytes() for x in left).decode().rstrip(" \t\n\v\f\r")
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(plain)], pa.array(out, texts.type)], names=[*plain, "text"])

    kinds = "".join(f"{p} {docs.schema[c].dataType.simpleString()}, " for c, p in zip(kept, plain, strict=True))
    back = dict(zip(kept, plain, strict=True)) | {text: "text"}
    done = _with_spans(_texts(own, plain[kept.index(doc_id)], "text"), n).mapInArrow(cut, kinds + "text string")
    return done.select(*(F.col(back[c]).alias(c) for c in docs.columns))


def op8_substring_dedup(spark, sf_dir):
    from veritome.llm.runtime import table

    return dedup_digest(table(spark, sf_dir, "documents"))

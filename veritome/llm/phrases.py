"""Phrase collocation mining by Rabin-Karp fingerprints: frequent phrases of each language, and how strongly their words belong together.

A text in lower case (A-Z) is split at marks and line ends into pieces, and these at blanks into words; phrases are sequences of words within a piece.

1. Fingerprints.  Prefix polynomials over the words' hashes, modulo 2 ** 64, give the fingerprint of every n-gram of a batch by a difference; language and length are part of it.
2. Counting.  Single words, pairs, then triples and quadruples are counted in three passes: each task adds up its fingerprints, a shuffle adds those of the tasks, and frequent ones stay.
   A phrase is only counted if the shorter phrases in it are frequent, as far as a bitmap of the frequent fingerprints tells: one bit each of at most 2 ** FILTER, so what is
   broadcast has a bound; a fuller bitmap lets more through, and changes no result.
3. Pointers.  A last pass takes the n-grams whose fingerprints are frequent.  In each batch, those of one fingerprint are compared with the first of them word for word in the text; what differs is a
   collision, and counted by itself.  Sorted, and with the bytes of one place together, pointers compress to about two thirds.  The shuffle then aggregates (fingerprint, digest of the text) with the count and a pointer to an occurrence: row, first and last byte.
4. Only the frequent phrases are materialised, each from the one occurrence that its pointer names.  Parts, cuts, and the longer phrases that make shorter ones redundant are joins of that table.

Cases: null and blank texts have no words; a null language is `und`; repeated rows count each time; null ids and further columns are allowed; empty tables give empty results; in a
tie of scores the more frequent phrase comes first, then that of smaller bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.llm.runtime import IDS, blocks_of, durable, partitions, written
from veritome.llm.text import _BLANK, _LOWER, U64, Words, _buffers, dealt, gathered, mix, pieces, words_of

LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
MARKS = b".,;:!?\n\v\f\r"
#: A bitmap of frequent fingerprints has at most 2 ** FILTER bits (32 MB); it has SPARSE bits for each of them as long as that is less.
FILTER, SPARSE = 28, 32
#: So many different fingerprints a task holds before it passes their counts on.
HELD = 4_000_000
_PIECE = 2 << 20
_SEPARATOR = _BLANK.copy()
_SEPARATOR[list(MARKS)] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(MARKS)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Grams:
    """The n-grams of a batch of texts; bits is how many bits of a fingerprint are kept."""

    def __init__(self, texts: pa.Array, languages: np.ndarray, bits: int):
        self.words = words_of(texts, True, _SEPARATOR)
        m = len(self.words.hash)
        self.text = np.repeat(np.arange(len(texts)), self.words.counts())
        self.piece = np.r_[0, np.cumsum(_MARK[self.words.data])][self.words.start] + self.text
        power, back = _powers(_BASE, m), _powers(_BACK, m)
        self.prefix, self.back = np.r_[U64(0), np.cumsum(mix(self.words.hash ^ U64(_BASE)) * power)], back
        self.salt, self.bits = mix(languages.astype(np.int64).view(U64) + U64(_BASE)), U64(64 - bits)

    def whole(self, n: int) -> np.ndarray:
        """At which words n-grams start that lie in one piece."""
        last = self.piece[n - 1 :]
        return np.flatnonzero(self.piece[: len(last)] == last)

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        value = (self.prefix[at + n] - self.prefix[at]) * self.back[at] + U64(n)
        return (mix(value ^ self.salt[self.text[at]]) >> self.bits) << self.bits

    def candidates(self, n: int, known: dict[int, Bitmap]) -> np.ndarray:
        """At which words n-grams start all of whose k-grams are frequent, for the longest k below n that is known."""
        at = self.whole(n)
        k = max((k for k in known if k < n), default=0)
        for step in range(n - k + 1 if k else 0):
            at = at[known[k].has(self.fingerprints(at + step, k))]
        return at


@dataclass
class Bitmap:
    """Which values of the top bits occur among frequent fingerprints."""

    bits: np.ndarray
    power: int

    def has(self, fingerprints: np.ndarray) -> np.ndarray:
        place = fingerprints >> U64(64 - self.power)
        return (self.bits[place >> U64(3)] >> (U64(7) - (place & U64(7))).astype(np.uint8)) & 1 == 1


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    return values[first], (np.add.reduceat(counts, first) if len(first) else counts)


def frequent_fingerprints(texts: DataFrame, sizes: tuple[int, ...], known: dict, least: int, bits: int) -> DataFrame:
    """texts (text, language) -> rows (bucket, hashes) with the fingerprints of n-grams of these sizes that occur so often; bucket is their top bits."""
    power = max(1, (blocks_of(texts) - 1).bit_length())

    def count(batches):
        filters, held = {k: b.value for k, b in known.items()}, []

        def deal():
            values, counts = _summed(np.concatenate([v for v, _ in held]), np.concatenate([c for _, c in held]))
            return dealt((values >> U64(64 - power)).astype(np.int64), [values, counts.astype(np.int64)], ["hashes", "counts"], planes=True)

        for piece in pieces(batches, "text", _PIECE):
            grams = Grams(piece.column(0), piece.column(1).to_numpy(), bits)
            for n in sizes:
                held.append(np.unique(grams.fingerprints(grams.candidates(n, filters), n), return_counts=True))
            if sum(len(v) for v, _ in held) > HELD:
                yield deal()
                held = []
        if held:
            yield deal()

    def add(table):
        values, counts = _summed(gathered(table, "hashes", U64, planes=True), gathered(table, "counts", np.int64, planes=True))
        values = values[counts >= least]
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "hashes": pa.array([values.tobytes()], pa.binary()), "n": pa.array([len(values)], pa.int64())})

    counted = texts.select("text", "language").mapInArrow(count, "bucket int, hashes binary, counts binary")
    return durable(counted.groupBy("bucket").applyInArrow(add, "bucket int, hashes binary, n long"))


def bitmap_of(frequent: DataFrame) -> Bitmap:
    """Buckets are intervals of fingerprints, so each sets the bits of a segment of its own, and the segments are all that is collected: 2 ** FILTER bits at most."""
    rows, total = frequent.agg(F.max("bucket"), F.sum("n")).first()
    power = min(FILTER, max(16, (SPARSE * (total or 1)).bit_length()))
    buckets = max(1, int(rows or 0).bit_length())
    power = max(power, buckets + 3)

    def segments(batches):
        for batch in batches:
            out = []
            for bucket, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.zeros(1 << (power - buckets), dtype=bool)
                place = (np.frombuffer(hashes.as_buffer(), U64) >> U64(64 - power)).astype(np.int64)
                own[place & (len(own) - 1)] = True
                out.append(((int(place[0]) >> (power - buckets)) if len(place) else bucket, np.packbits(own).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["segment", "bits"])

    bits = np.zeros(1 << (power - 3), dtype=np.uint8)
    width = len(bits) >> buckets
    for row in frequent.where("n > 0").select("bucket", "hashes").mapInArrow(segments, "segment int, bits binary").toLocalIterator():
        bits[row.segment * width : (row.segment + 1) * width] |= np.frombuffer(row.bits, np.uint8)
    return Bitmap(bits, power)


def same_words(words: Words, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether words x[i] and y[i] are the same bytes in lower case."""
    size = words.end[x] - words.start[x]
    out = size == words.end[y] - words.start[y]
    padded = np.r_[_LOWER[words.data], np.zeros(8, np.uint8)]
    eights = np.ndarray((len(words.data) + 1,), "<u8", padded, strides=(1,))
    tail = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)
    at, open_ = 0, np.flatnonzero(out)
    while len(open_ := open_[out[open_] & (size[open_] > at)]):
        mask = tail[np.minimum(size[open_] - at, 8)]
        out[open_] = eights[words.start[x[open_]] + at] & mask == eights[words.start[y[open_]] + at] & mask
        at += 8
    return out


def verified_groups(grams: Grams, at: np.ndarray, n: int, values: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first occurrence of each different n-gram, and how often it occurs; n-grams of one fingerprint are compared word for word, and with their languages."""
    firsts, counts = [], []
    order = np.argsort(values, kind="stable")
    at, values = at[order], values[order]
    while len(at):
        start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        lead = np.repeat(at[start], np.diff(np.r_[start, len(at)]))
        same = language[grams.text[at]] == language[grams.text[lead]]
        for k in range(n):
            same &= same_words(grams.words, at + k, lead + k)
        firsts.append(at[start])
        counts.append(np.add.reduceat(same, start, dtype=np.int64))
        at, values = at[~same], values[~same]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *firsts]), np.concatenate([none, *counts])


#: A phrase of a task: what it is, how often it occurs, and where.  A text has less than 4 GB, and so has a task's input words.
_PHRASE = {"size": np.uint8, "fingerprint": U64, "digest": np.int64, "f": np.uint32, "row": np.int64, "start": np.uint32, "bytes": np.uint32}


def _merged(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of the same first three columns are one: the fourth is added up, of the others the first stays."""
    order = np.lexsort((columns[2], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)][: len(order)])
    return [(np.add.reduceat(c, first, dtype=c.dtype) if len(first) else c) if i == 3 else c[first] for i, c in enumerate(columns)]


def occurrences(texts: DataFrame, known: dict, longest: int, least: int, bits: int) -> DataFrame:
    """texts (row, text, language, lang) -> (size, fingerprint, digest, f, row, start, bytes): each frequent phrase, with its count and a pointer to one of its
    occurrences; size 0 are all words of a language."""
    power = max(1, (blocks_of(texts) - 1).bit_length())

    def point(batches):
        filters, held, size = {k: b.value for k, b in known.items()}, [], 0

        def deal():
            return dealt((held[0][1] >> U64(64 - power)).astype(np.int64), held[0], list(_PHRASE), planes=True)

        for piece in pieces(batches, "text", _PIECE):
            rows = piece.column(2).to_numpy()
            coded = piece.column(3).dictionary_encode()
            language, lang = coded.indices.to_numpy(), [x.encode() for x in coded.dictionary.to_pylist()]
            grams = Grams(piece.column(0), piece.column(1).to_numpy(), bits)
            words, low = grams.words, _LOWER[grams.words.data].tobytes()
            of_text = _buffers(piece.column(0))[1]
            one = np.unique(language, return_index=True)[1]
            total = np.bincount(language, weights=words.counts(), minlength=len(lang))
            zero = np.zeros(len(one), np.int64)
            found = [[zero, zero, [_digest(lang[i], b"") for i in language[one]], total[language[one]], rows[one], zero, zero]]
            for n in range(1, longest + 1):
                at = grams.candidates(n, filters)
                values = grams.fingerprints(at, n)
                keep = filters[n].has(values)
                first, times = verified_groups(grams, at[keep], n, values[keep], language)
                row, start, stop = grams.text[first], words.start[first], words.end[first + n - 1]
                digest = [_digest(lang[language[r]], low[x:y]) for r, x, y in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)]
                found.append([np.full(len(first), n), grams.fingerprints(first, n), digest, times, rows[row], start - of_text[row], stop - start])
            held.append([np.concatenate([np.asarray(c, t) for c in own]) for own, t in zip(zip(*found, strict=True), _PHRASE.values(), strict=True)])
            size += len(held[-1][0])
            if size > HELD // 2:
                held = [_merged([np.concatenate(c) for c in zip(*held, strict=True)])]
                size = len(held[0][0])
                if size > HELD // 4:
                    yield deal()
                    held, size = [], 0
        if held:
            held = [_merged([np.concatenate(c) for c in zip(*held, strict=True)])]
            yield deal()

    def add(table):
        parts = {name: gathered(table, name, t, planes=True) for name, t in _PHRASE.items()}
        columns = _merged([parts[name].astype(np.int64) if name == "f" else parts[name] for name in parts])
        keep = (columns[3] >= least) | (columns[0] == 0)
        return pa.table({name: pa.array(c[keep].view(np.int64) if c.dtype == U64 else c[keep].astype(np.int64)) for name, c in zip(_PHRASE, columns, strict=True)})

    pointed = texts.select("text", "language", "row", "lang").mapInArrow(point, "bucket int, " + ", ".join(f"{c} binary" for c in _PHRASE))
    return pointed.groupBy("bucket").applyInArrow(add, ", ".join(f"{c} long" for c in _PHRASE))


def _digest(lang: bytes, phrase: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(lang + b"\n" + b" ".join(phrase.split()), digest_size=8).digest(), "little", signed=True)


def frequent_phrases(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int = 64) -> DataFrame:
    """(lang, size, phrase, f): each phrase of up to so many words that occurs so often in the language; size 0 with an empty phrase has the number of all words."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))
    texts = rows.select(F.xxhash64("doc_id", "lang", "text").alias("row"), "text", F.xxhash64("lang").alias("language"), "lang")
    known: dict = {}
    for sizes in [(n,) for n in range(1, min(longest, 2) + 1)] + ([tuple(range(3, longest + 1))] if longest > 2 else []):
        bitmap = bitmap_of(frequent_fingerprints(texts, sizes, known, least, bits))
        shared = docs.sparkSession.sparkContext.broadcast(bitmap)
        known = known | dict.fromkeys(sizes, shared)
    found = durable(occurrences(texts, known, longest, least, bits))
    pointers = found.groupBy("row").agg(F.collect_list(F.struct("start", "bytes", "size", "fingerprint", "digest", "f")).alias("pointers"))
    pointers = F.broadcast(pointers) if found.count() <= IDS else pointers

    def materialise(batches):
        for batch in batches:
            out = []
            for own, value, pointed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                for p in pointed:
                    phrase = b" ".join(data[p["start"] : p["start"] + p["bytes"]].lower().split())
                    if _digest(own.encode(), phrase) == p["digest"]:  # else another row has the same hash
                        out.append((own, p["size"], phrase.decode(), p["f"], p["fingerprint"], p["digest"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["lang", "size", "phrase", "f", "fingerprint", "digest"])

    pointed = texts.select("row", "lang", "text").join(pointers, "row").select("lang", "text", "pointers")
    phrases = pointed.mapInArrow(materialise, "lang string, size long, phrase string, f long, fingerprint long, digest long")
    return written(phrases.dropDuplicates(["size", "fingerprint", "digest"]).select("lang", "size", "phrase", "f"))


def collocations(docs: DataFrame, *, top: int = TOP, cover: int = COVER, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of two words or more by the score of their weakest cut, without those that a longer one covers."""
    phrases = frequent_phrases(docs, **options)
    part = lambda name, f: phrases.where("size > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    split = phrases.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    piece = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("size") - 1).cast("int")))).withColumn("size", F.col("size").cast("int"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("first"), piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).withColumn("score", F.expr("CAST(CAST(2000000 AS DECIMAL(7, 0)) * a DIV (l + r) AS BIGINT)"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = split.where("size > 2").withColumn("size", F.col("size").cast("int")).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))).alias("salt"))
    some = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)  # so that the last window has a bounded number of rows
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(phrases.where("size = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    from veritome.llm.runtime import table

    return collocations(table(spark, sf_dir, "documents"))

"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document when at least `percent` of the item's distinct
word shingles are among the document's.  Items are partitioned by the size of their shingle
sets.  The sketch of an item is its k smallest shingle hashes (a bottom-k MinHash), where the
partition's sizes set k: a document that has enough of an item's q shingles lacks at most
q - ceil(q * percent / 100) of them, so of one more than that it has one at least.  Thus the
search misses nothing, however long the document.  A partition is searched only for documents
with enough shingles to contain its smallest item.  Every candidate is then verified by the exact
overlap of the two shingle sets.

An item of fewer than n words is the one shingle of all its words, and is looked for among the shingles of as many words: items of each such length are searched
as a set of their own, in the same pass where items are broadcast.

Items whose texts take up to `broadcast_bytes` are broadcast, and documents never leave their partition.
Beyond that bound, sketches and shingles meet in shuffled joins.

Cases: a null or blank text has no shingles and is contained in nothing, and contains nothing; an item of
fewer than n words is contained where its words follow one another, in long and in short documents; repeated rows of documents or items give
repeated rows; ids may be null; further columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.llm.oracles import WORD
from veritome.llm.runtime import table, without_ids
from veritome.llm.text import U64, pieces, shingle_sets, words_of

BROADCAST_BYTES = 32 << 20
#: Beyond it, the documents' shingles are dealt into so many parts of each hash, and those of the items, which are fewer, go to all of them.
SALTS = 16
_FILTER_BITS = 20


def _needed(q: np.ndarray, percent: int) -> np.ndarray:
    return -(-q * percent // 100)


class Sketches:
    """The items by size partition (sizes from 2**i up to 2**(i + 1) - 1), with sketches and whole shingle sets."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent, self.partitions = sets, percent, []
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        for power in range(int(sizes.max(initial=0)).bit_length()):
            own = np.flatnonzero((sizes >= 1 << power) & (sizes < 2 << power))
            if not len(own):
                continue
            lengths = sizes[own] - _needed(sizes[own], percent) + 1
            keys = np.concatenate([sets[i][:k] for i, k in zip(own, lengths, strict=True)])
            owner, order = np.repeat(own, lengths), np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
            seen[keys >> U64(64 - _FILTER_BITS)] = True
            self.partitions.append((int(_needed(sizes[own], percent).min()), keys[order], owner[order], seen))

    def search(self, sets: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of all documents, given by their shingle sets, that contain an item."""
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        found: set[tuple[int, int]] = set()
        for least, keys, owner, seen in self.partitions:
            large = np.flatnonzero(sizes >= least)
            if not len(large):
                continue
            values, doc = np.concatenate([sets[i] for i in large]), np.repeat(large, sizes[large])
            maybe = np.flatnonzero(seen[values >> U64(64 - _FILTER_BITS)])
            left, right = np.searchsorted(keys, values[maybe]), np.searchsorted(keys, values[maybe], side="right")
            for at in np.flatnonzero(right > left).tolist():
                found.update((int(doc[maybe[at]]), int(i)) for i in owner[left[at] : right[at]])
        out = []
        for d, i in sorted(found):
            at = np.searchsorted(sets[d], self.sets[i])
            shared = int((sets[d][np.minimum(at, len(sets[d]) - 1)] == self.sets[i]).sum())
            if 100 * shared >= self.percent * len(self.sets[i]):
                out.append((d, i, shared))
        return out


def contained_items(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", n: int = 5, percent: int = 80, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row (doc_id, item_id, n_item_shingles, n_shared) for every document and item that it contains."""
    docs, items = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, n_item_shingles long, n_shared long"
    if (items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0) > broadcast_bytes:
        length = F.least(F.regexp_count("text", F.lit(WORD)), F.lit(n))
        lengths = sorted(r[0] for r in items.select(length).distinct().collect() if r[0])
        return reduce(DataFrame.unionByName, [_shuffled(docs, items.where(length == k), k, percent) for k in lengths or [n]])
    rows = items.toArrow().combine_chunks()
    texts = pa.array([x.as_py() for x in rows.column("text")], pa.string())
    ids = rows.column("item_id").to_pylist()
    words = words_of(texts, True)
    lengths = np.minimum(np.diff(words.first), n)
    searches = []
    for length in np.unique(lengths[lengths > 0]).tolist():
        sets = [s if own else s[:0] for s, own in zip(shingle_sets(words, length), lengths == length, strict=True)]
        searches.append((length, Sketches(sets, percent)))
    broadcast = docs.sparkSession.sparkContext.broadcast((searches, ids))
    schema = T._parse_datatype_string(kinds)

    def search(batches):
        searches, ids = broadcast.value
        for piece in pieces(batches, "text"):
            words = words_of(piece.column(1), True)
            for length, sketches in searches:
                found = sketches.search(list(shingle_sets(words, length)))
                if found:
                    d, i, shared = (list(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(d)), pa.array([ids[x] for x in i], rows.schema.field("item_id").type), pa.array([len(sketches.sets[x]) for x in i], pa.int64()), pa.array(shared, pa.int64())], names=schema.names)

    return docs.mapInArrow(search, schema)


def _exploded(df: DataFrame, n: int) -> DataFrame:
    """A row (row, id, size, rank, h) for each distinct shingle of each text; row tells repeated rows of the same id apart."""
    key, kind = df.columns[0], df.schema[0].dataType.simpleString()

    def explode(batches):
        for piece in pieces(batches, "text", 1 << 20):
            sets = list(shingle_sets(words_of(piece.column(2), True), n))
            sizes = [len(s) for s in sets]
            at = pa.array(np.repeat(np.arange(len(sets)), sizes))
            rank = np.concatenate([np.arange(s) for s in sizes]) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([piece.column(1).take(at), piece.column(0).take(at), pa.array(np.repeat(sizes, sizes).astype(np.int64)), pa.array(rank.astype(np.int64)), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], names=["row", key, "size", "rank", "h"])

    numbered = df.groupBy(key, "text").count().select(key, F.xxhash64(key, "text").alias("row"), "text")
    return numbered.mapInArrow(explode, f"row long, {key} {kind}, size long, rank long, h long")


def _shuffled(docs: DataFrame, items: DataFrame, n: int, percent: int) -> DataFrame:
    doc, item = _exploded(docs, n), _exploded(items, n).withColumnRenamed("row", "item_row").withColumnRenamed("size", "n_item_shingles")
    needed = F.ceil(F.col("n_item_shingles") * percent / 100)
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = doc.where(F.col("size") > 0).drop("rank").withColumn("part", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    pairs = item.where(F.col("rank") <= F.col("n_item_shingles") - needed).withColumn("part", parts).join(salted, ["h", "part"]).where(F.col("size") >= needed).select("row", "item_row").distinct()
    shared = pairs.join(item.select("item_row", "item_id", "n_item_shingles", "h"), "item_row").join(doc.select("row", "doc_id", "h"), ["row", "h"])
    found = shared.groupBy("row", "item_row", "doc_id", "item_id", "n_item_shingles").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * percent)
    times = lambda df, key, row, name: df.groupBy(key, "text").agg(F.count("*").alias(name)).select(F.xxhash64(key, "text").alias(row), name)
    found = found.join(times(docs, "doc_id", "row", "n1"), "row").join(times(items, "item_id", "item_row", "n2"), "item_row")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("n1") * F.col("n2")).cast("int")))).select("doc_id", "item_id", "n_item_shingles", "n_shared")


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs, by doc_id, that contain no item."""
    return without_ids(docs, contained_items(docs, items, **options).select("doc_id"), options.get("doc_id", "doc_id"))


def op10_decontaminate(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

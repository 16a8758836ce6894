"""Near-duplicate groups by SuperMinHash: signatures, banding, verification of full sets, and union-find grouping.

Documents are sets of distinct n-word shingles; two link when 100 * |A and B| >= percent * |A or B|. Documents with equal sets form a class.

1. Signatures.  An element gives each of M slots a rank, a permutation of 0..M-1, and the value rank + fraction; a slot keeps the least value of all elements.  Ranks are taken round by
   round: in round j each element of a set offers its value to the slot where its rank is j.  A slot that a round has filled is final, since later values are larger, so a set stops as
   soon as all slots are filled (early stopping): a large set after a round or two, a set of one element after M.
   As an element has each rank once, slots are negatively correlated and the share of equal slots varies less about the Jaccard index than that of independent minima.  The permutation is
   slot = b + a * j modulo the prime M, with a and b from the element's hash: these maps take any two slots to any two ranks equally often, as all permutations do, and
   the variance depends on pairs of slots only.
2. Banding.  Bands of ROWS slots, dealt at random once, are hashed; classes with an equal band meet.  At an index of 0.8 all 42 bands differ with a probability of (1 - 0.8 ** 5) ** 42 = 6e-8.
3. Verification.  The class of a band that meets most others is its hub, and the classes that meet a hub are joined in nodes of a bounded size: by the exact overlap of their full sets, without those
   that union-find has connected already, and across nodes of one hub as well (see `jaccard.linked_groups`).  No list of all pairs of a band is made.
4. Grouping.  Links within nodes are joined by union-find, the nodes' links by label propagation with pointer jumping.

Cases: as in `jaccard`: null and blank texts link with nothing, with fewer than n words the whole sequence is one shingle, repeated rows and null ids are kept, further columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.llm.jaccard import _signed, fingerprint, linked_groups
from veritome.llm.runtime import durable
from veritome.llm.text import U64, mix, pieces, shingle_sets, words_of

SLOTS, ROWS, SHINGLE = 211, 5, 2
_FRACTION, _EMPTY, _STEP = U64(48), U64(0xFFFFFFFFFFFFFFFF), U64(0x9E3779B97F4A7C15)
#: So many sets that a task has met lately are known as met.
_MET = 100_000


def signatures(values: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A row of slots for each set values[first[i]:first[i + 1]], whose elements are distinct hashes; slots is a prime.  The top 16 bits of a slot are the rank, the others the fraction."""
    sets = len(first) - 1
    out = np.full(sets * slots, _EMPTY, dtype=U64)
    owner = np.repeat(np.arange(sets), np.diff(first))
    own = mix(values ^ U64(0x2545F4914F6CDD1D))
    slope, slot = 1 + ((own >> U64(32)) % U64(slots - 1)).astype(np.int64), ((own & U64(0xFFFFFFFF)) % U64(slots)).astype(np.int64)
    for rank in range(slots):
        if not len(owner):
            break
        at = owner * slots + slot
        open_ = np.flatnonzero(out[at] == _EMPTY)
        value = (mix(own[open_] + U64(rank * int(_STEP) & 0xFFFFFFFFFFFFFFFF)) >> U64(16)) | (U64(rank) << _FRACTION)
        np.minimum.at(out, at[open_], value)
        live = np.unique(owner)
        full = np.zeros(sets, dtype=bool)
        full[live] = (out.reshape(sets, slots)[live] != _EMPTY).all(1)
        going = np.flatnonzero(~full[owner])
        owner, own, slope = owner[going], own[going], slope[going]
        slot = (slot[going] + slope) % slots
    return out.reshape(sets, slots)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Hashes of the bands of each row, whose slots are dealt by a fixed shuffle; a band's number is part of its hash."""
    slots = signature.shape[1]
    dealt = np.random.default_rng(7).permutation(slots)[: slots // rows * rows].reshape(-1, rows)
    out = np.broadcast_to(mix(np.arange(1, len(dealt) + 1, dtype=U64)), (len(signature), len(dealt))).copy()
    for r in range(rows):
        out = mix(out * _STEP ^ signature[:, dealt[:, r]])
    return out


def banded_profile(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of docs (doc_id, text); bands are null where the task has given those of an equal set."""

    def profile(batches):
        met = np.zeros(0, dtype=U64)
        for piece in pieces(batches, "text"):
            sets = list(shingle_sets(words_of(piece.column(1), True), n))
            keys, size = np.array([fingerprint(s) for s in sets], dtype=U64), np.array([len(s) for s in sets], dtype=np.int64)
            _, once = np.unique(keys, return_index=True)
            once = np.sort(once[(size[once] > 0) & ~np.isin(keys[once], met)])
            met = np.concatenate([met, keys[once]])[-_MET:]
            chosen = [sets[i] for i in once]
            signed = signatures(np.concatenate(chosen) if chosen else np.zeros(0, dtype=U64), np.r_[0, np.cumsum(size[once])])
            lists: list = [None] * len(sets)
            for i, row in zip(once.tolist(), _signed(bands(signed)), strict=True):
                lists[i] = row
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size), pa.array(_signed(keys)), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(profile, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_key long, bands array<long>")


def met_in_bands(profile: DataFrame) -> DataFrame:
    """(hub, key): the classes that share a band with a hub, itself included; classes of one band have a hub in common.

    The hub is the member that meets most others over all its bands: nearly all bands of a group of near copies agree on it, so that a class has few hubs.
    """
    each = profile.where("bands IS NOT NULL").select(F.col("set_key").alias("key"), F.explode("bands").alias("band"))
    sizes = each.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last").select("band", "n")
    shared = durable(each.join(sizes, "band"))
    weights = shared.groupBy("key").agg(F.sum("n").alias("weight"))
    hubs = shared.join(weights, "key").groupBy("band").agg(F.max(F.struct("weight", "key")).alias("hub")).select("band", F.col("hub.key").alias("hub"))
    return shared.join(hubs, "band").select("hub", "key").distinct()


def superminhash_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the smallest doc_id that links reach, the document's own included, which alone is kept."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    profile = durable(banded_profile(docs, n))
    groups = linked_groups(docs, profile.drop("bands"), durable(met_in_bands(profile)), n, percent)
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_superminhash(spark, sf_dir):
    from veritome.llm.runtime import table

    return superminhash_groups(table(spark, sf_dir, "documents"))

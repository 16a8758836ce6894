"""Cross-tokenizer alignment by galloping intersection: which tokens of two tokenizers share bytes, and how good each pair is over the whole corpus.

1. Both tokenizers encode every whole text, after a space.  A text is cut where neither can join two tokens: before a space between two characters that aren't blank, of which one is
   ASCII, if no piece of the second has a space behind another character.  The parts are encoded once a task (`Parts`), and their tokens are put together again.
2. Galloping.  A document's tokens are two increasing lists of byte ends.  The ends of the shorter list are searched in the longer one, each from the place of an end before it: steps
   of 1, 2, 4, .. until they pass it, then a binary search within the last step.  All ends of a batch gallop at the same time: every 4096th of a document from its start, every
   512th from the 4096th before it, and so on.
3. An end that both lists have cuts the groups.  An end's rank in the longer list, and the rank of the end before it, bound the tokens of the longer list that a token overlaps: its links.
4. Counts.  Texts go in blocks of about BLOCK_BYTES; a block has a dictionary of its id pairs, and each document's links are places in it.  The dictionaries, not the links, are summed over the corpus
   by pair; each B id's highest count follows, and each block gets the counts of its own dictionary back.  No count is broadcast, and the most frequent pair is one row of each block.

Cases: texts that are null or empty, or whose tokens' bytes aren't the text's (a U+2581 in it, say), have no tokens: zeros and ''.  Special tokens' strings are plain text.  Repeated
rows count each time, null ids are kept, further columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.llm.runtime import written
from veritome.llm.text import _buffers, pieces

FOLDER = "/opt/tokenizers"
BLOCK_BYTES, PIECE_BYTES = 16 << 20, 2 << 20
#: So many different parts of texts a task remembers the tokens of.
PARTS = 400_000
_STRIDES = (4096, 512, 64, 8, 1)


class Vocabularies:
    """A byte-level BPE (A) and a sentence-piece BPE (B), with the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
        self.a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[1:-1], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.cuts = not any("▁" in t.lstrip("▁") for t in names)

    def encoded(self, parts: list[bytes]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of A and of B of parts that start with a space, and whether the bytes of both are the part's."""
        texts = [p.decode() for p in parts]
        a, b = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, b, [b"".join([self.a_bytes[i] for i in x]) == p == b"".join([self.b_bytes[i] for i in y]) for p, x, y in zip(parts, a, b, strict=True)]


@cache
def vocabularies(a: str, b: str) -> Vocabularies:
    return Vocabularies(a, b)


class Parts(dict):
    """The numbers of the parts met so far, and the tokens of each."""

    def __init__(self, tokenizers: Vocabularies):
        self.tokenizers, self.new, self.good = tokenizers, [], np.zeros(0, dtype=bool)
        self.ids, self.first, self.number = ([np.zeros(0, np.int32)] * 2, [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2)

    def __missing__(self, part: bytes) -> int:
        self[part] = number = len(self)
        self.new.append(part)
        return number

    def learn(self) -> None:
        """Encodes the parts that are new."""
        if not self.new:
            return
        *ids, good = self.tokenizers.encoded(self.new)
        self.good, self.new = np.r_[self.good, np.array(good, dtype=bool)], []
        for side in (0, 1):
            number = np.array([len(x) for x in ids[side]], dtype=np.int64)
            self.first[side] = np.r_[self.first[side], len(self.ids[side]) + np.cumsum(number) - number]
            self.number[side] = np.r_[self.number[side], number]
            self.ids[side] = np.r_[self.ids[side], np.fromiter((i for x in ids[side] for i in x), np.int32, int(number.sum()))]

    def forget(self) -> None:
        if len(self) > PARTS:
            self.clear()
            self.__init__(self.tokenizers)


def spread(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (number[0] of them), then those from first[1], .."""
    before = np.cumsum(number) - number
    return np.repeat(first - before, number) + np.arange(int(number.sum()))


def gallop(ends: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each end the first of longer[low:high] that isn't less; place is its number in its list, in which ends increase and each has such a one."""
    found, before = low.copy(), 0
    for stride in _STRIDES:
        at = np.flatnonzero(place % stride == 0) if stride > 1 else np.arange(len(ends))
        if before:
            at = at[place[at] % before != 0]
            found[at] = found[at - place[at] % before]
        left, right, step, going = found[at], high[at] - 1, 1, np.arange(len(at))
        while len(going):  # longer[:left] is less
            probe = left[going] + step - 1
            less = (probe < right[going]) & (longer[np.minimum(probe, len(longer) - 1)] < ends[at[going]])
            right[going[~less]] = np.minimum(probe[~less], right[going[~less]])
            left[going[less]] = probe[less] + 1
            going, step = going[less], step * 2
        going = np.flatnonzero(left < right)
        while len(going):
            middle = (left[going] + right[going]) >> 1
            less = longer[middle] < ends[at[going]]
            left[going[less]], right[going[~less]] = middle[less] + 1, middle[~less]
            going = going[left[going] < right[going]]
        found[at], before = left, stride
    return found


class Alignment:
    """Of a batch of documents: ends and ids of A and then of B, and where each document's start."""

    def __init__(self, ends: list[np.ndarray], ids: list[np.ndarray], numbers: list[np.ndarray]):
        self.ends, self.ids, self.numbers, self.n_a = np.concatenate(ends), np.concatenate(ids), numbers, len(ends[0])
        firsts = [np.cumsum(numbers[0]) - numbers[0], self.n_a + np.cumsum(numbers[1]) - numbers[1]]
        self.a_drives = numbers[0] <= numbers[1]
        first, self.number = np.where(self.a_drives, firsts[0], firsts[1]), np.minimum(*numbers)
        low = np.where(self.a_drives, firsts[1], firsts[0])
        self.doc, self.token = np.repeat(np.arange(len(first)), self.number), spread(first, self.number)
        place = self.token - first[self.doc]
        rank = gallop(self.ends[self.token], place, low[self.doc], (low + np.maximum(*numbers))[self.doc], self.ends)
        common = self.ends[rank] == self.ends[self.token] if len(rank) else np.zeros(0, bool)
        self.closes = np.zeros(len(self.ends), dtype=bool)
        self.closes[self.token[common]] = self.closes[rank[common]] = True
        after = np.r_[0, (rank + common)[:-1]][: len(rank)]
        self.start = np.where(place == 0, low[self.doc], after)
        self.overlaps = rank - self.start + 1
        self.n_groups = np.bincount(self.doc[common], minlength=len(first))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each link the document, the A id and the B id."""
        own, other = np.repeat(self.token, self.overlaps), spread(self.start, self.overlaps)
        doc = np.repeat(self.doc, self.overlaps)
        swap = ~self.a_drives[doc]
        return doc, self.ids[np.where(swap, other, own)].astype(np.int64), self.ids[np.where(swap, own, other)].astype(np.int64)

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups, written as `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        a, b = self.closes[: self.n_a], self.closes[self.n_a :]
        group_a, group_b = np.cumsum(a) - a, np.cumsum(b) - b
        of_a, of_b = np.bincount(group_a, minlength=1), np.bincount(group_b, minlength=1)
        at = np.r_[np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a], np.arange(len(b)) + np.cumsum(of_a)[group_b]]
        digits, size = _decimals(int(self.ids.max(initial=0)) + 1)
        order = np.empty(len(at), dtype=np.int64)
        order[at] = np.arange(len(at))
        written_ = digits[self.ids[order]]
        size = size[self.ids[order]]
        mark = np.where(self.closes, np.repeat(np.frombuffer(b"|;", np.uint8), (len(a), len(b))), np.uint8(ord(",")))[order]
        written_[np.arange(len(at)), size] = mark
        flat = written_[np.arange(digits.shape[1]) <= size[:, None]].tobytes()
        stop = np.r_[0, np.cumsum(size + 1)][np.cumsum(self.numbers[0] + self.numbers[1])].tolist()
        return [hashlib.sha256(flat[x : y - 1]).hexdigest() if y > x else "" for x, y in zip([0, *stop], stop, strict=False)]


@cache
def _decimal_table(power: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.arange(1 << power)
    names = numbers.astype(f"S{len(str(1 << power))}")
    size = np.char.str_len(names)
    return np.concatenate([names.view(np.uint8).reshape(len(numbers), -1), np.zeros((len(numbers), 1), np.uint8)], 1), size


def _decimals(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0, 1, .. as rows of bytes with room for a mark, and how many there are."""
    return _decimal_table(max(1, (count - 1).bit_length()))


def part_bounds(data: np.ndarray, first: np.ndarray, cuts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of texts data[first[i]:first[i + 1]] start, the first one of each included, and how many each text has."""
    full = np.flatnonzero(np.diff(first))
    starts = first[:-1][full]
    if cuts and len(data) > 2:
        before, after = data[:-2], data[2:]
        at = 1 + np.flatnonzero((data[1:-1] == 32) & (before > 32) & (after > 32) & ((before < 128) | (after < 128)))
        edge = np.zeros(len(data) + 2, dtype=bool)
        edge[starts] = edge[first[1:][full] - 1] = True  # texts aren't neighbours
        starts = np.sort(np.r_[starts, at[~edge[at]]])
    number = np.searchsorted(starts, first[1:]) - np.searchsorted(starts, first[:-1])
    return starts, number


def aligned(texts: pa.Array, parts: Parts) -> Alignment:
    """The alignment of texts; of those that are null, empty or not the bytes of their tokens, that of no tokens."""
    data, first = _buffers(texts)
    starts, number = part_bounds(data, first, parts.tokenizers.cuts)
    blob, stops = data.tobytes(), np.r_[starts[1:], len(data)].tolist()
    leads = np.zeros(len(starts), dtype=bool)
    leads[np.searchsorted(starts, first[:-1][number > 0])] = True
    part = np.array([parts[b" " + blob[x:y] if lead else blob[x:y]] for x, y, lead in zip(starts.tolist(), stops, leads.tolist(), strict=False)], dtype=np.int64)
    parts.learn()
    doc = np.repeat(np.arange(len(number)), number)
    bad = np.bincount(doc[~parts.good[part]], minlength=len(number)) > 0
    part = part[~bad[doc]]
    doc = doc[~bad[doc]]
    ends, ids, numbers = [], [], []
    for side, table in enumerate((parts.tokenizers.a_bytes, parts.tokenizers.b_bytes)):
        count = parts.number[side][part]
        own = parts.ids[side][spread(parts.first[side][part], count)]
        ids.append(own)
        ends.append(np.cumsum(_lengths(tuple(table))[own]))
        numbers.append(np.bincount(doc, weights=count, minlength=len(number)).astype(np.int64))
    return Alignment(ends, ids, numbers)


@cache
def _lengths(table: tuple[bytes, ...]) -> np.ndarray:
    return np.array([len(x) for x in table], dtype=np.int64)


_ROW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned_blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (block, doc_id, n_a .. groups_sha256, places, times) of documents, whose links are places in the block's dictionary, and (block, pairs, totals), the dictionary of each block."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def align(batches):
        parts, number, held, size = Parts(vocabularies(a, b)), 0, [], 0
        width = len(parts.tokenizers.b_bytes)
        shift = (len(parts.tokenizers.a_bytes) * width).bit_length()

        def flush():
            pairs, place = np.unique(np.concatenate([p for _, _, p, _ in held]), return_inverse=True)
            totals = np.bincount(place, weights=np.concatenate([t for _, _, _, t in held]), minlength=len(pairs)).astype(np.int64)
            block, at = (TaskContext.get().partitionId() << 32) | number, 0
            for columns, cuts, own, times in held:
                here, at = place[at : at + len(own)].astype(np.uint32), at + len(own)
                bounds = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bounds), block)), *columns, pa.array([here[x:y].tobytes() for x, y in bounds], pa.binary()), pa.array([times[x:y].astype(np.uint32).tobytes() for x, y in bounds], pa.binary()), pa.nulls(len(bounds), pa.list_(pa.int64())), pa.nulls(len(bounds), pa.list_(pa.int64()))],
                    schema=pa.schema([pa.field(n, t) for n, t in zip(names, [pa.int64(), columns[0].type, *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 2, *[pa.list_(pa.int64())] * 2], strict=True)]),
                )
            doc_type = held[0][0][0].type
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.nulls(1, doc_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), *[pa.nulls(1, pa.binary())] * 2, pa.array([pairs], pa.list_(pa.int64())), pa.array([totals], pa.list_(pa.int64()))], names=names
            )

        for piece in pieces(batches, "text", PIECE_BYTES):
            parts.forget()
            own = aligned(piece.column(1), parts)
            doc, left, right = own.links()
            key, times = np.unique((doc << shift) | (left * width + right), return_counts=True)
            n_links = np.bincount(doc, minlength=piece.num_rows)
            cuts = np.searchsorted(key, np.arange(piece.num_rows + 1) << shift).tolist()
            held.append(([piece.column(0), *map(pa.array, (*own.numbers, own.n_groups, n_links)), pa.array(own.digests(), pa.string())], cuts, key & ((1 << shift) - 1), times))
            size += piece.column(1).nbytes
            if size >= BLOCK_BYTES:
                yield from flush()
                number, held, size = number + 1, [], 0
        if held:
            yield from flush()

    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "pairs", "totals"]
    return docs.mapInArrow(align, f"block long, doc_id {kind}, {_ROW}, places binary, times binary, pairs array<long>, totals array<long>")


def pair_counts(requests: DataFrame, width: int) -> DataFrame:
    """requests (pair, total) of all blocks -> (pair, count, best): how many links hold the pair, and whether no pair of its B id has more."""
    counts = written(requests.groupBy("pair").agg(F.sum("total").alias("count")).withColumn("b", F.col("pair") % width))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def token_alignment(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    paths = f"{folder}/{a}", f"{folder}/{b}"
    blocks = written(aligned_blocks(docs, *paths))
    requests = blocks.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("place", "entry")).select("block", "place", F.col("entry.pairs").alias("pair"), F.col("entry.totals").alias("total"))
    counts = pair_counts(requests.select("pair", "total"), len(vocabularies(*paths).b_bytes))
    answers = requests.select("block", "place", "pair").join(counts, "pair").select((F.col("block") + 0).alias("of_block"), "place", "count", "best")

    def digest(key, own, answered):
        place = answered.column("place").to_numpy()
        size = int(place.max(initial=-1)) + 1
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        count[place], best[place] = answered.column("count").to_numpy(), answered.column("best").to_numpy(zero_copy_only=False)
        n_best, sums = [], []
        for p, t in zip(own.column("places"), own.column("times"), strict=True):
            at, times = np.frombuffer(p.as_buffer(), np.uint32), np.frombuffer(t.as_buffer(), np.uint32).astype(np.int64)
            n_best.append(int((times * best[at]).sum()))
            sums.append(int((times * count[at]).sum()))
        return own.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = blocks.where("pairs IS NULL").drop("pairs", "totals")
    return rows.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(digest, f"doc_id {kind}, {_ROW}, n_best long, count_sum long")


def op11_token_alignment(spark, sf_dir):
    from veritome.llm.runtime import table

    return token_alignment(table(spark, sf_dir, "documents"))

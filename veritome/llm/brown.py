"""Language model scoring with Brown class-based bigrams.

P(word | word before) = P(class | history) * P(word | class).  Exchange clustering assigns every word of the training texts to a class, and the end of a text to one of its own.

1. The FREQUENT most frequent words, and all others in TAILS groups by their last two bytes, are exchanged on one matrix of bigram counts: each moves to the class
   that raises the likelihood of the class bigrams most, until none moves.  The classes of these items are the histories: whatever word comes before, seen or not, has one.
2. Every word is counted by the histories before it, in blocks by the word's hash: CLASSES numbers at most, which are all that its best class depends on.  Starting from its item's class,
   each word of the vocabulary is then exchanged, block by block: a pass moves each word to the class that raises the likelihood of (history, class) most, half of the words at a time; a class
   other than its item's has to raise it by log(CLASSES) more, what it takes to name it, so that a rare word doesn't follow the chance of its few places.  Words are moved
   on a copy of the table of histories and classes, which is added up anew after each pass.  Passes go on until the likelihood grows by less than CLOSE of itself.
   Then the KEPT most frequent words take their own classes as histories, all others that of most words of their group, and the words are counted and exchanged once more.
3. Class transitions are interpolated with class frequencies; a class gives each of its words its count plus DELTA, and DELTA to an unseen one.  An unseen word has the class to which most
   words of its group belong.

Counts and classes are of all training texts and all their words, and grow with them.  Only the KEPT most frequent words are broadcast, whatever the corpus, so that their tokens needn't
be shuffled; tokens of other words meet their words' counts and classes in the words' blocks, and what they add to a text is summed by text.

Cases: a null text counts as empty, one end token; without training texts every word is unknown and the model is uniform over classes; repeated rows are kept; ids may be null (they train);
further columns are ignored; empty tables give empty results.  Words are told apart by 64-bit hashes; of equally frequent words those with the smaller hashes come first.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritome.llm.language import bucket
from veritome.llm.runtime import blocks_of, durable
from veritome.llm.text import U64, Words, dealt, gathered, mix, pieces, words_of

FREQUENT, TAILS, CLASSES, KEPT = 1500, 96, 32, 65_536
DELTA, CLOSE, ROUNDS = 0.1, 1e-4, 2
END = U64(0)
_HELD = 1 << 20


def tail_groups(words: Words) -> np.ndarray:
    """The group of each word by its last two bytes, of its letters in lower case."""
    if not len(words.start):
        return np.zeros(0, dtype=np.uint8)
    last = words.data[words.end - 1].astype(np.uint32)
    before = words.data[np.maximum(words.end - 2, words.start)].astype(np.uint32)
    fold = lambda b: np.where((b >= 65) & (b <= 90), b + 32, b)
    return (((fold(before) * 251 + fold(last)) * np.uint32(2654435761)) >> np.uint32(8)).astype(np.uint32) % np.uint32(TAILS)


class Lookup:
    """Places of 64-bit keys in a sorted table; most keys that aren't there are told by a bit of their own."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, 20
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[keys >> U64(64 - self.bits)] = True

    def places(self, values: np.ndarray) -> np.ndarray:
        """-1 where a value isn't in the table."""
        out = np.full(len(values), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[values >> U64(64 - self.bits)])
        if len(self.keys) and len(maybe):
            at = np.minimum(np.searchsorted(self.keys, values[maybe]), len(self.keys) - 1)
            good = self.keys[at] == values[maybe]
            out[maybe[good]] = at[good]
        return out


def distinct(words: Words) -> tuple[Words, np.ndarray, np.ndarray]:
    """The distinct words, sorted by hash, as words of one text; the place of each word among them; and how often each occurs."""
    order = np.argsort(words.hash)
    h = words.hash[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    times = np.diff(np.r_[start, len(h)])
    back, at = np.empty(len(h), dtype=np.int64), order[start]
    back[order] = np.repeat(np.arange(len(start)), times)
    return Words(words.data, words.start[at], words.end[at], np.array([0, len(at)]), h[start]), back, times


def added(codes: np.ndarray, times: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, all below size, in order, and the sums of their times, which are above 0."""
    if size <= 8 * len(codes):
        total = np.bincount(codes, times, size)
        found = np.flatnonzero(total)
        return found, total[found].astype(np.int64)
    found, place = np.unique(codes, return_inverse=True)
    return found, np.bincount(place, times, len(found)).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """Blocks (bucket, hashes, counts, groups) of the distinct words of texts (text), each block sorted by hash."""
    count = blocks_of(texts)

    def merged(held):
        h, c, g = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, c, g = h[order], c[order], g[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        return h[start], np.add.reduceat(c, start) if len(h) else c, g[start]

    def counted(batches):
        held, size = [], 0
        for piece in pieces(batches, "text"):
            words, _, c = distinct(words_of(piece.column(0), True))
            held.append((words.hash, c.astype(np.int64), tail_groups(words).astype(np.uint8)))
            size += len(c)
            if size > _HELD:
                held = [merged(held)]
                size = len(held[0][0])
                if size > _HELD // 2:
                    yield dealt((held[0][0] % U64(count)).astype(np.uint32), list(held[0]), ["hashes", "counts", "groups"])
                    held, size = [], 0
        if held:
            own = merged(held)
            yield dealt((own[0] % U64(count)).astype(np.uint32), list(own), ["hashes", "counts", "groups"])

    def block(key, table):
        h, c, g = merged([(gathered(table, "hashes", U64), gathered(table, "counts", np.int64), gathered(table, "groups", np.uint8))])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "hashes": pa.array([h.tobytes()], pa.binary()), "counts": pa.array([c.tobytes()], pa.binary()), "groups": pa.array([g.tobytes()], pa.binary())})

    kinds = "bucket int, hashes binary, counts binary, groups binary"
    return texts.mapInArrow(counted, kinds).groupBy("bucket").applyInArrow(block, kinds)


def _rows(blocks: DataFrame, make, kinds: str) -> DataFrame:
    """The rows that make(hashes, counts, groups) returns, as a list of arrays, for each block."""
    names = [x.split()[0] for x in kinds.split(", ")]

    def each(batches):
        for batch in batches:
            for h, c, g in zip(*(batch.column(x) for x in ("hashes", "counts", "groups")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in make(np.frombuffer(h.as_buffer(), U64), np.frombuffer(c.as_buffer(), np.int64), np.frombuffer(g.as_buffer(), np.uint8))], names=names)

    return blocks.mapInArrow(each, kinds)


def most_frequent(blocks: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and groups, sorted by hash, of the `most` most frequent words.  A histogram of the counts tells how far down they go; only of its last bin a part is sorted."""
    bins = lambda c: np.floor(np.log2(c) * 32).astype(np.int64)

    def histogram(h, c, g):
        found, n = np.unique(bins(c), return_counts=True)
        return found, n

    total, last = 0, None
    for row in _rows(blocks, histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy(F.desc("bin")).collect():
        last = row["bin"]
        if total + row["n"] > most:
            break
        total += row["n"]
    else:
        last = None if last is None else last - 1

    def among(keep):
        return _rows(blocks, lambda h, c, g: (h[keep(c)].view(np.int64), c[keep(c)], g[keep(c)].astype(np.int32)), "h long, c long, g int")

    if last is None:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    above = among(lambda c: bins(c) > last)
    rest = among(lambda c: bins(c) == last).orderBy(F.desc("c"), "h").limit(max(most - total, 1))
    got = above.union(rest).toArrow() if most > total else above.toArrow()
    h = got.column("h").to_numpy().view(U64)
    order = np.argsort(h)
    return h[order], got.column("c").to_numpy()[order], got.column("g").to_numpy()[order].astype(np.uint8)


def bigram_counts(texts: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """The matrix of counts of (item, next item): frequent words, tail groups, and last the end of a text, which also comes before the first word."""
    n = len(frequent) + TAILS + 1
    keys = texts.sparkSession.sparkContext.broadcast(frequent)

    def counted(batches):
        lookup, total = Lookup(keys.value), np.zeros(n * n, dtype=np.int64)
        for piece in pieces(batches, "text"):
            total += np.bincount(_pairs(items_of(words_of(piece.column(0), True), lookup), n), minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(n * n, dtype=np.int64)
    got = texts.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(n, n)


def items_of(words: Words, lookup: Lookup) -> np.ndarray:
    """The items of all texts in a row, the end item after each text."""
    place = lookup.places(words.hash)
    item = np.where(place >= 0, place, len(lookup.keys) + tail_groups(words).astype(np.int64))
    return np.insert(item, words.first[1:], len(lookup.keys) + TAILS)


def _pairs(items: np.ndarray, n: int) -> np.ndarray:
    return np.r_[n - 1, items[:-1]] * n + items


def exchange(n: np.ndarray, classes: int, passes: int | None = None) -> np.ndarray:
    """The class of each item of a bigram count matrix; the last item keeps the last class to itself.  It runs until no item moves, or for so many passes."""
    items, end = len(n), classes - 1
    n = n.astype(np.float64)
    left, right = n.sum(0), n.sum(1)
    order = np.argsort(-(left + right), kind="stable")
    order = order[order != items - 1]
    own = np.empty(items, dtype=np.int64)
    own[order], own[items - 1] = np.arange(items - 1) % end, end
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    g = np.zeros((classes, classes))
    np.add.at(g, (own[:, None], own[None, :]), n)
    a, b = np.bincount(own, left, classes), np.bincount(own, right, classes)
    choices = np.arange(classes)
    for _ in itertools.count() if passes is None else range(passes):
        moved = 0
        for w in order:
            c, s = own[w], n[w, w]
            row = np.bincount(own, n[w], classes)
            col = np.bincount(own, n[:, w], classes)
            row[c] -= s
            col[c] -= s
            g[c] -= row
            g[:, c] -= col
            g[c, c] -= s
            a[c] -= left[w]
            b[c] -= right[w]
            gain = (f(g + col[:, None]) - f(g)).sum(0) + (f(g + row[None, :]) - f(g)).sum(1)
            d = g[choices, choices]
            gain += f(d + row + col + s) - f(d + col) - f(d + row) + f(d)
            gain -= f(a + left[w]) - f(a) + f(b + right[w]) - f(b)
            gain[end] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            moved += best != c
            own[w] = best
            g[best] += row
            g[:, best] += col
            g[best, best] += s
            a[best] += left[w]
            b[best] += right[w]
        if not moved:
            break
    return own


_WORDS = {"hashes": U64, "counts": np.int64, "groups": np.uint8, "classes": np.uint8, "given": np.uint8, "pairs": np.uint32, "times": np.int64}
_KINDS = "bucket int, " + ", ".join(f"{c} binary" for c in _WORDS)


def history_counts(texts: DataFrame, histories: Histories, classes: int) -> DataFrame:
    """Blocks of all distinct words of texts (text), and the end of a text as the word END: hashes, counts, groups, the classes to start from, which are those that the words have as histories,
    and, in the order of words, the pairs (word's place in the block * classes + history) that occur and their times."""
    count, shared = blocks_of(texts), texts.sparkSession.sparkContext.broadcast(histories)

    def merged(held):
        h, pair_word, pair_history, times, groups = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        pairs, times = added(back[pair_word] * classes + pair_history, times, len(keys) * classes)
        return keys, pairs // classes, (pairs % classes).astype(np.int64), times, groups[at]

    def stacked(parts):
        """Parts of (hashes, pairs' words as places in the part, ..), with the places in all of them."""
        at = np.cumsum([0, *(len(p[0]) for p in parts)])
        return merged([(p[0], p[1] + a, p[2], p[3], p[4]) for p, a in zip(parts, at[:-1], strict=True)])

    def sent(part):
        h, word, history, times, groups = part
        values = np.r_[h, np.full(len(word), 0, U64)]
        values[len(h) :] = h[word]
        is_pair = np.arange(len(values)) >= len(h)
        return dealt(values % U64(count), [(h, ~is_pair), (groups, ~is_pair), (h[word], is_pair), (history.astype(np.uint8), is_pair), (times, is_pair)], ["hashes", "groups", "words", "histories", "times"])

    def counted(batches):
        histories = shared.value
        held, size = [], 0
        for piece in pieces(batches, "text"):
            words = words_of(piece.column(0), True)
            some, back, _ = distinct(words)
            keys, groups, ends = some.hash, tail_groups(some), words.first[1:]
            own = histories.of(some, groups)[back]
            before = np.r_[classes - 1, np.insert(own, ends, classes - 1)[:-1]] if len(ends) else np.zeros(0, np.int64)
            word = np.insert(back, ends, len(keys))
            held.append(merged([(np.r_[keys, END], word, before, np.ones(len(word)), np.r_[groups, 0].astype(np.uint8))]))
            size += len(held[-1][1])
            if size > _HELD:
                held = [stacked(held)]
                size = len(held[0][1])
                if size > _HELD // 2:
                    yield sent(held[0])
                    held, size = [], 0
        if held:
            yield sent(stacked(held))

    def block(key, table):
        histories = shared.value
        h, groups, words, history, times = (gathered(table, c, t) for c, t in (("hashes", U64), ("groups", np.uint8), ("words", U64), ("histories", np.uint8), ("times", np.int64)))
        keys, at = np.unique(h, return_index=True)
        pairs, times = added(np.searchsorted(keys, words) * classes + history, times, len(keys) * classes)
        counts = np.bincount(pairs // classes, times, len(keys)).astype(np.int64)
        first = histories.classes[_items(keys, groups[at], histories.keys)].copy()
        first[keys == END] = classes - 1
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([v.astype(t).tobytes()], pa.binary()) for (c, t), v in zip(_WORDS.items(), (keys, counts, groups[at], first, first, pairs, times), strict=True)}})

    return texts.mapInArrow(counted, "bucket int, hashes binary, groups binary, words binary, histories binary, times binary").groupBy("bucket").applyInArrow(block, _KINDS)


def _items(h: np.ndarray, groups: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each word's item: a frequent word by itself, any other as its group."""
    place = Lookup(keys).places(h)
    return np.where(place >= 0, place, len(keys) + groups.astype(np.int64))


@dataclass
class Histories:
    """The class of what comes before: keys are the frequent words' hashes, classes those of all items."""

    keys: np.ndarray
    classes: np.ndarray

    def of(self, words: Words, groups: np.ndarray) -> np.ndarray:
        return self.classes[_items(words.hash, groups, self.keys)]


def _each_block(blocks: DataFrame, make, kinds: str) -> DataFrame:
    """The batches that make(columns of a block by name) returns, one for each block."""

    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield make(row["bucket"], {c: np.frombuffer(row[c], t) for c, t in _WORDS.items()})

    return blocks.mapInArrow(each, kinds)


def class_table(blocks: DataFrame, classes: int) -> np.ndarray:
    """How often each (history, class) occurs under the blocks' classes."""

    def cells(bucket, b):
        found, n = added((b["pairs"] % classes) * classes + b["classes"][b["pairs"] // classes], b["times"], classes * classes)
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n)], names=["cell", "n"])

    out = np.zeros(classes * classes, dtype=np.int64)
    for cell, n in _each_block(blocks, cells, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(classes, classes)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(g: np.ndarray) -> float:
    """What of the log likelihood depends on the classes."""
    return float(_f(g.astype(np.float64)).sum() - _f(g.sum(0).astype(np.float64)).sum())


def gains(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the log likelihood gains in each class by n more words after history h: a row for each pair (h, n), worked out once for equal pairs."""
    if len(h) < 256:
        return _f(g[h] + n[:, None]) - _f(g[h])
    kinds, place = np.unique(n.astype(np.int64) * len(g) + h, return_inverse=True)
    h, n = kinds % len(g), (kinds // len(g)).astype(np.float64)
    return (_f(g[h] + n[:, None]) - _f(g)[h])[place]


def exchanged(words: dict[str, np.ndarray], g: np.ndarray, turn: int, cost: float) -> np.ndarray:
    """The classes of a block's words after each word whose turn it is has moved to its best class; frequent words move one by one, rare ones by up to 4,096 at once."""
    classes, own = len(g), words["classes"].astype(np.int64)
    g = g.astype(np.float64)
    word, history, times = words["pairs"].astype(np.int64) // classes, words["pairs"].astype(np.int64) % classes, words["times"].astype(np.float64)
    start = np.searchsorted(word, np.arange(len(own) + 1))
    order = np.argsort(-words["counts"], kind="stable")
    order = order[((mix(words["hashes"][order].copy()) & U64(1)) == U64(turn % 2)) & (words["hashes"][order] != END)]
    limit, at = max(g.sum() / 2000, 1.0), 0
    sizes = np.cumsum(words["counts"][order])
    while at < len(order):
        stop = max(at + 1, min(at + 4096, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right"))))
        chosen = order[at:stop]
        length = start[chosen + 1] - start[chosen]
        first = np.cumsum(np.r_[0, length])[:-1]
        p = np.repeat(start[chosen] - first, length) + np.arange(length.sum())
        h, n, c, total = history[p], times[p], own[chosen], words["counts"][chosen].astype(np.float64)
        column = g.sum(0)
        gain = np.add.reduceat(gains(g, h, n), first, axis=0) - (_f(column + total[:, None]) - _f(column))
        old = g[h, np.repeat(c, length)]
        leave = np.add.reduceat(_f(old - n) - _f(old), first) - (_f(column[c] - total) - _f(column[c]))
        gain += leave[:, None]
        gain[np.arange(len(chosen)), c] = 1e-9
        gain[np.arange(len(chosen)), words["given"][chosen]] += cost
        gain[:, -1] = -np.inf
        best = gain.argmax(1)
        np.subtract.at(g, (h, np.repeat(c, length)), n)
        np.add.at(g, (h, np.repeat(best, length)), n)
        own[chosen] = best
        at = stop
    return own.astype(np.uint8)


def exchange_all(blocks: DataFrame, classes: int, close: float = CLOSE, cost: float | None = None) -> DataFrame:
    """Blocks of history_counts() with the classes that exchange gives all their words.  A pass that doesn't raise the likelihood isn't taken."""
    cost = math.log(classes) if cost is None else cost
    g, quiet, turn = class_table(blocks, classes), 0, 0
    while quiet < 2 and g.any():

        def move(bucket, b, g=g, turn=turn):
            columns = b | {"classes": exchanged(b, g, turn, cost)}
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([columns[c].tobytes()], pa.binary()) for c in _WORDS)], names=["bucket", *_WORDS])

        moved = durable(_each_block(blocks, move, _KINDS))
        new = class_table(moved, classes)
        before, after = likelihood(g), likelihood(new)
        quiet = 0 if after > before + close * abs(before) else quiet + 1
        if after > before:
            blocks, g = moved, new
        turn += 1
    return blocks


@dataclass
class BrownModel:
    histories: Histories
    kept: np.ndarray
    kept_counts: np.ndarray
    kept_classes: np.ndarray
    unseen: np.ndarray
    transition: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int
    ends: int

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.words + 1)))

    def emission(self, c: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.log10((c + DELTA) / (self.class_tokens[own] + DELTA * (self.class_words[own] + 1)))


def _classes_of(blocks: DataFrame, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and classes of some words of the blocks, given by sorted hashes."""

    def found(bucket, b):
        at = np.flatnonzero(Lookup(words).places(b["hashes"]) >= 0)
        return pa.RecordBatch.from_arrays([pa.array(b["hashes"][at].view(np.int64)), pa.array(b["counts"][at]), pa.array(b["classes"][at].astype(np.int32))], names=["h", "n", "c"])

    got = _each_block(blocks, found, "h long, n long, c int").toArrow()
    order = np.argsort(got.column("h").to_numpy().view(U64))
    return got.column("n").to_numpy()[order], got.column("c").to_numpy()[order].astype(np.int64)


def _class_sizes(blocks: DataFrame, otherwise: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By class how many words and tokens, and by group the class of most of its words (or the one given)."""

    def totals(bucket, b):
        cell = np.where(b["hashes"] == END, TAILS, b["groups"].astype(np.int64)) * classes + b["classes"]
        cells, at = np.unique(cell, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.bincount(at).astype(np.int64)), pa.array(np.bincount(at, b["counts"], len(cells)).astype(np.int64))], names=["cell", "words", "tokens"])

    size = np.zeros((TAILS + 1, classes, 2), dtype=np.int64)
    for cell, n, tokens in _each_block(blocks, totals, "cell long, words long, tokens long").groupBy("cell").agg(F.sum("words"), F.sum("tokens")).collect():
        size[cell // classes, cell % classes] = n, tokens
    words = size[:TAILS, :, 0]
    return size[..., 0].sum(0), size[..., 1].sum(0).astype(np.float64), np.where(words.any(1), words.argmax(1), otherwise)


def fit(texts: DataFrame, *, frequent: int = FREQUENT, classes: int = CLASSES, kept: int = KEPT, rounds: int = ROUNDS) -> tuple[BrownModel, DataFrame]:
    """The model of the training texts (text), and the blocks of all their words with counts and classes."""
    counts = durable(word_counts(texts))
    words, times, groups = most_frequent(counts, max(kept, frequent))
    order = np.lexsort((words, -times))
    top, kept_words = np.sort(order[:frequent]), np.sort(words[order[:kept]])
    following = Histories(words[top], exchange(bigram_counts(texts, words[top]), classes)[:-1])
    for _ in range(rounds):
        histories = following
        blocks = exchange_all(durable(history_counts(texts, histories, classes)), classes)
        kept_counts, kept_classes = _classes_of(blocks, kept_words)
        class_words, class_tokens, unseen = _class_sizes(blocks, histories.classes[len(histories.keys) :], classes)
        following = Histories(kept_words, np.r_[kept_classes, unseen])
    g = class_table(blocks, classes)
    share = (class_tokens + 1) / (class_tokens.sum() + classes)
    transition = np.log10((g + 5 * share) / (g.sum(1, keepdims=True) + 5))
    return BrownModel(histories, kept_words, kept_counts, kept_classes, unseen, transition, class_tokens, class_words, int(class_tokens.sum()), int(class_words.sum()), int(class_tokens[-1])), blocks


def scored(docs: DataFrame, model: BrownModel, blocks: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)."""
    count = blocks.select("bucket").agg(F.max("bucket")).first()[0]
    count = max(blocks_of(docs), (count or 0) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "*")
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean"

    def before(m, words, place, groups):
        """The history of each word; place is that of each word among the kept ones, which are mostly those that have histories of their own."""
        end = len(m.transition) - 1
        same = np.array_equal(m.histories.keys, m.kept)
        own = m.histories.classes[np.where(place >= 0, place, len(m.kept) + groups.astype(np.int64))] if same else m.histories.of(words, groups)
        out = np.r_[end, own[:-1]][: len(own)]
        out[words.first[:-1][np.diff(words.first) > 0]] = end
        return out, own

    def known(batches):
        """What a text has of frequent words, and of all others as if they were unknown."""
        m = shared.value
        lookup, end = Lookup(m.kept), len(m.transition) - 1
        for piece in pieces(batches, "text"):
            words = words_of(piece.column(3), True)
            place, groups = lookup.places(words.hash), tail_groups(words)
            own = np.where(place >= 0, m.kept_classes[place] if len(m.kept) else 0, m.unseen[groups])
            c = np.where(place >= 0, m.kept_counts[place] if len(m.kept) else 0, 0)
            history, after = before(m, words, place, groups)
            sums = lambda x: np.diff(np.r_[0, np.cumsum(x)][words.first])
            last = np.where(np.diff(words.first) > 0, after[np.maximum(words.first[1:] - 1, 0)] if len(after) else end, end)
            ends, n = np.array([m.ends]), words.counts() + 1
            score = sums(m.emission(c, own) + m.transition[history, own]) + m.emission(ends, np.array([end]))[0] + m.transition[last, end]
            yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(np.ones(len(n), np.int64)), pa.array(n), pa.array(sums(place >= 0).astype(np.int64) + (m.ends > 0)), pa.array(sums(m.base(c)) + m.base(ends)[0]), pa.array(score)], names=["row", "doc_id", "held_out", "copies", "n_tokens", "n_known", "base_score", "score"])

    def others(batches):
        m = shared.value
        lookup = Lookup(m.kept)
        for piece in pieces(batches, "text"):
            words = words_of(piece.column(1), True)
            place = lookup.places(words.hash)
            rest = np.flatnonzero(place < 0)
            if not len(rest):
                continue
            row = np.repeat(piece.column(0).to_numpy().view(U64), words.counts())[rest]
            h = words.hash[rest]
            yield dealt(h % U64(count), [h, row, before(m, words, place, tail_groups(words))[0][rest].astype(np.uint8)], ["word_hashes", "rows", "before"])

    def corrected(key, left, right):
        """What the words of a block that occur in training texts add to their texts."""
        m = shared.value
        h, row, history = gathered(left, "word_hashes", U64), gathered(left, "rows", U64), gathered(left, "before", np.uint8)
        keys, counts, groups, classes = (gathered(right, c, _WORDS[c]) for c in ("hashes", "counts", "groups", "classes"))
        order = np.argsort(keys)
        keys, counts, groups, classes = keys[order], counts[order], groups[order], classes[order]
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        good = np.flatnonzero(keys[at] == h) if len(keys) else np.zeros(0, np.int64)
        c, own, other, row, history = counts[at[good]].astype(np.float64), classes[at[good]], m.unseen[groups[at[good]]], row[good], history[good]
        zero = np.zeros_like(c)
        names, at = np.unique(row, return_inverse=True)
        total = lambda x: np.bincount(at, x, len(names))
        more = m.emission(c, own) + m.transition[history, own] - m.emission(zero, other) - m.transition[history, other]
        sums = [names, np.bincount(at, minlength=len(names)).astype(np.int64), total(m.base(c) - m.base(zero)), total(more)]
        return pa.Table.from_batches([dealt(mix(names.copy()) % U64(count), sums, ["rows", "known", "bases", "scores"])])

    def summed(table):
        """One row for each text of what the blocks have of it."""
        names, at = np.unique(gathered(table, "rows", U64), return_inverse=True)
        total = lambda c, t: np.bincount(at, gathered(table, c, t), len(names))
        return pa.table({"row": pa.array(names.view(np.int64)), "n_known": pa.array(total("known", np.int64).astype(np.int64)), "base_score": pa.array(total("bases", np.float64)), "score": pa.array(total("scores", np.float64))})

    own = rows.select("row", "doc_id", "held_out", "text").mapInArrow(known, f"row long, {kinds}, copies long, n_tokens long, n_known long, base_score double, score double")
    tail = rows.select("row", "text").mapInArrow(others, "bucket int, word_hashes binary, rows binary, before binary")
    more = tail.groupBy("bucket").cogroup(blocks.groupBy("bucket")).applyInArrow(corrected, "bucket int, rows binary, known binary, bases binary, scores binary")
    more = more.groupBy("bucket").applyInArrow(summed, "row long, n_known long, base_score double, score double")
    total = own.unionByName(more, allowMissingColumns=True).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.bool_or("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base_score", "score")))
    each = [(F.col(c) / F.col("copies")).cast(k).alias(c) for c, k in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))]
    total = total.select("doc_id", "held_out", *each, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def class_model_scores(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """Learns from the rows of docs that are not held out, and scores all."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    return scored(docs, *fit(docs.where("NOT held_out").select("text"), **sizes))


def op4_brown_classes(spark, sf_dir):
    from veritome.llm.runtime import table

    return class_model_scores(table(spark, sf_dir, "documents"), bucket(F.col("doc_id"), 10) == 0)

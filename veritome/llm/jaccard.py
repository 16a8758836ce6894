"""N-gram Jaccard join by signature trees, and the groups of documents that its links connect.

Documents are sets of distinct n-word shingles; two link when 100 * |A and B| >= percent * |A or B|.
Documents with equal sets form a class, known by a 64-bit fingerprint of the set, and the join is one of classes.

1. The split of the root.  Sizes are cut into ranges so that linked sets are in one range or in neighbouring ones,
   and a range's hash space into P parts.  Linked sets differ in at most D = (range's largest size) * 2 * (100 - percent) / (100 + percent)
   shingles, so at most D of the parts that are not empty in one set differ in the other.  A set has a signature for each
   part that is not empty, for its own range and the next one up.  With more than D such parts, one at least
   is equal in both sets and the two meet in a block; sets with fewer are "weak" and meet in a block of their own.
   As K parts that are not empty leave at least K - D equal ones, a set that shares fewer with all others together has no partner and leaves its blocks.
   Where more than LED sets of one piece of the input have a signature, one is sent, their leader, and the others follow it wherever it goes: a block has a bounded number of entries from each piece.
   Blocks that have the same hub, the member that shares most parts over all blocks, are one subtree.
2. A subtree is cut into nodes of at most TILE members and SHINGLES shingles, of similar sizes where there are several.  In each node a signature tree
   joins its members: leaves are token bitmaps, a node above them has the OR of its children's bitmaps, the range of their sizes, and the most tokens that any has beyond its bits.
   Two nodes can share at most popcount(OR1 & OR2) + min(excess) tokens and at most the smaller of their largest sizes; a pair of
   nodes that can't reach the overlap asked for, or whose members are all connected, is pruned, else its children are compared.  Pairs of leaves that stay are verified by the exact
   overlap of their sets, and those that link connect their members.  The hub is a member of every node.
3. The dual traversal across nodes.  Where the nodes of one subtree aren't connected to each other, the members outside its largest component are cut into nodes again,
   and pairs of one such node with any other are pruned by the same bounds on OR-bitmaps, size ranges and components; what stays is compared by the trees of both.

The bounds are exact, so no link between different sets is lost; a link within a component need not be looked at.
Signatures take 16 bytes; whole sets are only made for classes that share a block, once, and travel once to each node they are in.

Cases: null and blank texts have the empty set and link with nothing (their own id is the component); with fewer than n words the
whole sequence is one shingle; repeated rows are kept, and so are null ids (ignored by the minimum); further
columns are ignored; empty tables give empty results.  Two different sets count as equal if their
64-bit fingerprints are, about one pair in 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.llm.components import connected_components
from veritome.llm.runtime import IDS, blocks_of, durable
from veritome.llm.text import U64, dealt, gathered, mix, pieces, several, shingle_sets, words_of

TILE, SHINGLES, LED = 1024, 1 << 21, 64
_COUNTED = np.uint32(1 << 31)
_LEAF = 8


def fingerprint(values: np.ndarray) -> int:
    return int(mix(mix(values ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)[None] + U64(len(values)))[0])


def _signed(values) -> np.ndarray:
    return np.asarray(values, dtype=U64).view(np.int64)


def bitmap_power(size: int) -> int:
    """A bitmap has the smallest power of two bits, 64 at least, that is twice the number of tokens or more."""
    return max(6, int(2 * size - 1).bit_length())


def bitmap(values: np.ndarray, power: int | None = None) -> bytes:
    """A token sets one bit of 2 ** power."""
    power = power or bitmap_power(len(values))
    out = np.zeros(1 << power, dtype=bool)
    out[mix(values) >> U64(64 - power)] = True
    return np.packbits(out).tobytes()


def folded(bitmaps: list[np.ndarray]) -> np.ndarray:
    """Rows of the width of the narrowest: of wider ones, neighbouring bits are ORed."""
    width, out = min(len(b) for b in bitmaps), []
    for b in bitmaps:
        if len(b) > width:
            b = np.packbits(np.unpackbits(b).reshape(width * 8, -1).any(1))
        out.append(b)
    return np.stack(out).view(U64)


def set_profile(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_key) of docs (doc_id, text)."""

    def profile(batches):
        for piece in pieces(batches, "text"):
            sets = list(shingle_sets(words_of(piece.column(1), True), n))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed([fingerprint(s) for s in sets]))], names=["doc_id", "n_shingles", "set_key"])

    return docs.mapInArrow(profile, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_key long")


class Ranges:
    """The ranges of set sizes: the first starts at the smallest size that can link with another set."""

    def __init__(self, percent: int, largest: int):
        low, self.percent = [next(a for a in range(1, 200) if 100 * a >= percent * (a + 1))], percent
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, -(-low[-1] * 100 // percent)))
        self.low = np.array(low + [-(-low[-1] * 100 // percent)], dtype=np.int64)
        self.differing = 2 * (self.low[1:] - 1) * (100 - percent) // (100 + percent)
        self.parts = self.differing * 23 // 20 + 6

    def signatures(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one sorted set, for its own range and the next one; and for each its tag: the range, and how many parts at least a partner has in common."""
        own = int(np.searchsorted(self.low, len(values), side="right")) - 1
        total = np.empty(len(values) + 1, dtype=U64)
        total[0] = 0
        np.cumsum(mix(values), out=total[1:])
        top, out, tags = values >> U64(32), [], []
        for r in (own, own + 1) if own + 1 < len(self.parts) else (own,):
            part = (top * U64(self.parts[r])) >> U64(32)
            start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sums = total[np.r_[start[1:], len(values)]] - total[start]
            out.append(mix(sums + (part[start] << U64(12)) + U64(r)))
            if len(start) <= self.differing[r]:
                out.append(mix(np.array([r + (1 << 60)], dtype=U64)))
            partner = min(int(self.low[r + 1]) - 1, len(values) * 100 // self.percent)
            least = max(1, len(start) - (len(values) + partner) * (100 - self.percent) // (100 + self.percent))
            tags.append(np.full(sum(map(len, out)) - sum(map(len, tags)), (r << 24) | min(least, (1 << 24) - 1), dtype=np.uint32))
        return np.concatenate(out), np.concatenate(tags)


def blocks(docs: DataFrame, n: int, percent: int, largest: int) -> DataFrame:
    """Rows (members) for each different block, rows (key, range, needed, shared), of a class in a range, how many parts others share, here and at least,
    and rows (leader, key): a class met a leader that has a signature of its."""
    count = blocks_of(docs)
    found = pa.schema([("members", pa.list_(pa.int64())), ("key", pa.int64()), ("range", pa.int32()), ("needed", pa.int32()), ("shared", pa.int64()), ("leader", pa.int64())])
    names = ["sigs", "keys", "tags", "leaders", "followers", "counted", "counted_tags", "times"]

    def signatures(batches):
        ranges, last = Ranges(percent, largest), np.zeros(0, dtype=U64)
        for piece in pieces(batches, "text"):
            parts, keys = [], []
            for s in shingle_sets(words_of(piece.column(0), True), n):
                if len(s) >= ranges.low[0]:
                    parts.append(s)
                    keys.append(fingerprint(s))
            keys = np.array(keys, dtype=U64)
            _, once = np.unique(keys, return_index=True)  # copies met in one task are one
            once = np.sort(once[~np.isin(keys[once], last)])
            last = np.concatenate([last, keys[once]])[-100_000:]
            own = [ranges.signatures(parts[i]) for i in once]
            if not own:
                continue
            keys = keys[once]
            at, sig, tag = np.repeat(np.arange(len(keys)), [len(x) for x, _ in own]), np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])
            order = np.argsort(sig, kind="stable")
            group = np.cumsum(np.r_[True, sig[order][1:] != sig[order][:-1]]) - 1
            crowd = order[np.bincount(group)[group] > LED]
            kept = np.ones(len(sig), bool)
            here = np.unique(at[crowd] << 32 | tag[crowd], return_counts=True)
            weight = np.bincount(at[crowd], minlength=len(keys))
            crowd = crowd[np.lexsort((at[crowd], -weight[at[crowd]], sig[crowd]))]
            first = np.r_[True, sig[crowd][1:] != sig[crowd][:-1]][: len(crowd)]
            kept[crowd[~first]] = False
            tag[crowd] |= _COUNTED
            leader = at[crowd][np.flatnonzero(first)[np.cumsum(first) - 1]] if len(crowd) else crowd
            pair = np.unique(leader[~first] * len(keys) + at[crowd[~first]])
            columns = [(sig[kept] & U64(0xFFFFFFFF)).astype(np.uint32), keys[at[kept]], tag[kept]], [keys[pair // len(keys)], keys[pair % len(keys)]], [keys[here[0] >> 32], (here[0] & 0xFFFFFFFF).astype(np.uint32), here[1].astype(np.uint32)]
            bucket = np.r_[(sig[kept] >> U64(32)) % U64(count), mix(columns[1][1].copy()) % U64(count), mix(columns[2][0].copy()) % U64(count)]
            kind = np.repeat([0, 1, 2], [len(c[0]) for c in columns])
            yield dealt(bucket, [(c, kind == k) for k, own in enumerate(columns) for c in own], names)

    def meet(table):
        sig, own, tag, leader, follower, counted, counted_tags, times = (gathered(table, c, t) for c, t in zip(names, (np.uint32, U64, np.uint32, U64, U64, U64, np.uint32, np.uint32), strict=True))
        order = np.argsort(sig, kind="stable")
        equal = sig[order][1:] == sig[order][:-1]
        order = order[np.r_[False, equal] | np.r_[equal, False]] if len(order) else order
        order = order[np.lexsort((own[order], sig[order]))]
        sig, own, tag = sig[order], own[order], tag[order]
        once = np.r_[True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])][: len(sig)]
        sig, own, tag = sig[once], own[once], tag[once]
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
        length = np.diff(np.r_[start, len(sig)])
        met = np.repeat(length > 1, length) & (tag < _COUNTED)
        key, tags, times = np.r_[own[met], counted], np.r_[tag[met], counted_tags], np.r_[np.ones(int(met.sum()), np.int64), times]
        order = np.lexsort((tags, key))
        key, tags, times = key[order], tags[order], times[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tags[1:] != tags[:-1])][: len(key)])
        shared = np.add.reduceat(times, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        members, seen = [], set()
        for a, k in zip(start[length > 1].tolist(), length[length > 1].tolist(), strict=True):
            group = own[a : a + k]
            mark = group.tobytes() if k < 4 else (k, int(mix(group).sum(dtype=U64)))
            if mark not in seen:
                seen.add(mark)
                members.append(_signed(group))
        pair = np.unique(np.stack([leader, follower], 1), axis=0)
        some = {
            "members": ({"members": pa.array(members, pa.list_(pa.int64()))}, len(members)),
            "counts": ({"key": pa.array(_signed(key[first])), "range": pa.array((tags[first] >> 24).astype(np.int32)), "needed": pa.array((tags[first] & 0xFFFFFF).astype(np.int32)), "shared": pa.array(shared)}, len(first)),
            "leaders": ({"leader": pa.array(_signed(pair[:, 0].copy())), "key": pa.array(_signed(pair[:, 1].copy()))}, len(pair)),
        }
        return pa.concat_tables([pa.table([columns.get(f.name, pa.nulls(rows, f.type)) for f in found], schema=found) for columns, rows in some.values()])

    signed = docs.select("text").mapInArrow(signatures, "bucket int, " + ", ".join(f"{c} binary" for c in names))
    return signed.groupBy("bucket").applyInArrow(meet, "members array<long>, key long, range int, needed int, shared long, leader long")


def subtrees(met: DataFrame) -> DataFrame:
    """Of the rows of blocks(): (hub, key), the members of each subtree; two linked classes are in one subtree at least."""
    led = met.where("leader IS NOT NULL").select("leader", "key").distinct()
    counted = met.where("range IS NOT NULL").groupBy("key", "range").agg(F.sum("shared").alias("weight"), F.max("needed").alias("needed")).where("weight >= needed").select("key", "weight")
    strong = durable(counted.groupBy("key").agg(F.max("weight").alias("weight")))
    led = durable(led.join(strong.select("key"), "key").join(strong.select(F.col("key").alias("leader")), "leader"))
    numbered = met.where("members IS NOT NULL").select("members").distinct().withColumn("block", F.xxhash64("members"))
    members = durable(numbered.select("block", F.explode("members").alias("key")).join(strong, "key"))
    hubs = members.groupBy("block").agg(F.max(F.struct("weight", "key")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("block", F.col("hub.key").alias("hub"))
    stars = members.join(hubs, "block").select("hub", "key").distinct()
    followed = stars.withColumnRenamed("key", "leader").join(led, "leader").select("hub", "key")
    own = led.select(F.col("leader").alias("hub"), "key").union(led.select("leader", "leader"))
    return stars.union(followed).union(own).distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, size, shingles binary) of the classes in wanted (key, doc_id): doc_id is a document of the class."""

    def shingles(batches):
        for piece in pieces(batches, "text", 1 << 20):
            sets = list(shingle_sets(words_of(piece.column(0), True), n))
            yield pa.RecordBatch.from_arrays([pa.array(_signed([fingerprint(s) for s in sets])), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "size", "shingles"])

    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= IDS else ids
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    found = texts.mapInArrow(shingles, "key long, size long, shingles binary")
    return found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


class SignatureTree:
    """Over members given by bitmaps, sizes and components; sorted by size, so that nodes have narrow ranges."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        self.order = np.lexsort((component, sizes))
        bitmaps, sizes, component = bitmaps[self.order], sizes[self.order], component[self.order]
        excess = sizes - np.bitwise_count(bitmaps).sum(1).astype(np.int64)
        self.levels = [(bitmaps, sizes, sizes, excess, component, component)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, excess, first, last = self.levels[-1]
            at = np.arange(0, len(low), _LEAF)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def pairs(self, other: SignatureTree, percent: int) -> np.ndarray:
        """Member indices (of self, of other) of the leaves that no bound rules out; with itself each pair once."""
        same, i, j = other is self, np.zeros(1, np.int64), np.zeros(1, np.int64)
        depth = max(len(self.levels), len(other.levels)) - 1
        for level in range(depth, -1, -1):
            a, b = self.levels[min(level, len(self.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
            keep = []
            for at in range(0, len(i), 4096):
                p, q = i[at : at + 4096], j[at : at + 4096]
                need = -(-percent * (a[1][p] + b[1][q]) // (100 + percent))
                most = np.minimum(np.bitwise_count(a[0][p] & b[0][q]).sum(1) + np.minimum(a[3][p], b[3][q]), np.minimum(a[2][p], b[2][q]))
                apart = (a[4][p] != a[5][p]) | (b[4][q] != b[5][q]) | (a[4][p] != b[4][q])
                keep.append((most >= need) & apart)
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            i, j = i[keep], j[keep]
            if not level:
                break
            wide_a, wide_b = level < len(self.levels), level < len(other.levels)
            sizes = len(self.levels[level - 1][1]) if wide_a else 1, len(other.levels[level - 1][1]) if wide_b else 1
            step_a, step_b = np.arange(_LEAF if wide_a else 1), np.arange(_LEAF if wide_b else 1)
            x = (i[:, None, None] * len(step_a) + step_a[None, :, None]) + np.zeros((1, 1, len(step_b)), np.int64)
            y = (j[:, None, None] * len(step_b) + step_b[None, None, :]) + np.zeros((1, len(step_a), 1), np.int64)
            x, y = x.ravel(), y.ravel()
            inside = (x < sizes[0]) & (y < sizes[1])
            if same:
                inside &= x < y if level == 1 else x <= y
            i, j = x[inside], y[inside]
        return np.stack([self.order[i], other.order[j]], 1) if len(i) else np.zeros((0, 2), np.int64)


class Members:
    """Classes that a task joins: keys, sets, and the component that each is known to be in."""

    def __init__(self, keys: np.ndarray, sets: list[np.ndarray], component: np.ndarray, percent: int, kind: type[SignatureTree] = SignatureTree):
        self.keys, self.sets, self.percent, self.kind = keys, sets, percent, kind
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        power = bitmap_power(int(self.sizes.max(initial=1)))
        self.bits = np.stack([np.frombuffer(bitmap(s, power), np.uint8) for s in sets]).view(U64) if sets else np.zeros((0, 1), U64)
        _, self.before = np.unique(component, return_inverse=True)
        self.now = self.before.copy()

    def tree(self, at: np.ndarray) -> SignatureTree:
        return self.kind(self.bits[at], self.sizes[at], self.now[at])

    def connect(self, i: int, others: np.ndarray) -> None:
        """Verifies i against those of the others that it isn't connected to, and connects it with what links."""
        others = others[self.now[others] != self.now[i]]
        if not len(others):
            return
        own, values = self.sets[i], np.concatenate([self.sets[j] for j in others])
        hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        shared = np.add.reduceat(hit, np.r_[0, np.cumsum(self.sizes[others])[:-1]])
        links = others[100 * shared >= self.percent * (len(own) + self.sizes[others] - shared)]
        if len(links):
            self.now[np.isin(self.now, self.now[links])] = self.now[i]

    def join(self, a: np.ndarray, b: np.ndarray | None = None) -> None:
        """By the trees of the members at a and at b, or the tree of a with itself."""
        first = self.tree(a)
        pairs = first.pairs(first if b is None else self.tree(b), self.percent)
        i, j = a[pairs[:, 0]], (a if b is None else b)[pairs[:, 1]]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
        for x, y in zip(start.tolist(), np.r_[start[1:], len(i)][: len(start)].tolist(), strict=True):
            self.connect(int(i[x]), j[x:y])

    def edges(self, last: int | None = None) -> pa.Table:
        """(a, b): what newly connects the components, from one member of each to one of them all, which isn't the member `last` if there is another."""
        order = np.arange(len(self.keys)) if last is None else np.r_[np.delete(np.arange(len(self.keys)), last), last]
        _, one = np.unique(self.before[order], return_index=True)
        one = order[np.sort(one)]
        one = one[np.argsort(self.now[one], kind="stable")]
        group = self.now[one]
        first = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]][: len(one)], np.arange(len(one)), 0)) if len(one) else one
        above = first + np.maximum(np.arange(len(one)) - first - 1, 0) // 32  # a tree of small degree, so that no node of the graph has very many links
        a, b = _signed(self.keys[one[above]]), _signed(self.keys[one])
        return pa.table({"a": pa.array(np.minimum(a, b)[a != b]), "b": pa.array(np.maximum(a, b)[a != b])})


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U64) for x in table.column("shingles")]


def joined_nodes(nodes: DataFrame, sets: DataFrame, percent: int, kind: type[SignatureTree] = SignatureTree) -> DataFrame:
    """nodes (hub, band, salt, key) -> links (a, b) that connect what is connected within a node; the hub is in each of its nodes."""

    def within(table):
        keys, hub = table.column("key").to_numpy().view(U64), table.column("hub")[0].as_py()
        members = Members(keys, _sets(table), np.arange(len(keys)), percent, kind)
        members.join(np.arange(len(keys)))
        return members.edges(int(np.flatnonzero(_signed(keys) == hub)[0]))

    return nodes.join(sets, "key").groupBy("hub", "band", "salt").applyInArrow(within, "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is short by count."""
    return F.broadcast(df) if df.limit(IDS + 1).count() <= IDS else df


def cut_into_nodes(members: DataFrame, by: list[str], whole: bool) -> DataFrame:
    """members (.., key, size) -> adds band and salt, which with `by` name nodes of about TILE members and SHINGLES shingles at most.
    If `whole`, what fits in one node isn't cut by size."""
    banded = members.withColumn("band", F.floor(F.log2(F.col("size")) * 3).cast("int"))
    counts = durable(banded.groupBy(*by, "band").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")))
    fits = (F.col("n") <= TILE) & (F.col("shingles") <= SHINGLES)
    large = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).where(~fits).select(*by)
    cuts = counts.join(large, by, "left_semi") if whole else counts
    cuts = _small(durable(cuts.select(*by, "band", F.ceil(F.greatest(F.col("n") / TILE, F.col("shingles") / SHINGLES)).cast("int").alias("salts"))))
    found = banded.join(cuts, [*by, "band"], "left")
    salt = F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")
    return found.select(*members.columns, F.when(F.col("salts").isNull(), -1).otherwise(F.col("band")).alias("band"), F.coalesce(salt, F.lit(0)).alias("salt"))


def crossing_links(members: DataFrame, sets: DataFrame, percent: int, kind: type[SignatureTree] = SignatureTree) -> DataFrame | None:
    """members (hub, key, size, component) of subtrees of several nodes -> links (a, b) between components of one subtree; None if all of them are connected."""
    counts = durable(members.groupBy("hub", "component").agg(F.count("*").alias("n"), F.max("size").alias("size")))
    apart = counts.groupBy("hub").agg(F.max(F.struct("n", "component")).alias("main"), F.max("size").alias("largest"), F.count("*").alias("components"))
    apart = durable(apart.where("components > 1").select("hub", F.col("main.component").alias("main"), "largest"))
    if apart.isEmpty():
        return None
    sided = members.join(_small(apart), "hub").select("hub", (F.col("component") != F.col("main")).alias("out"), "largest", "key", "size", "component")
    nodes = durable(cut_into_nodes(sided, ["hub", "out"], whole=False).withColumn("node", F.concat_ws(",", F.col("out").cast("int"), "band", "salt")))

    def summary(table):
        """What a node above its members knows of them."""
        power = bitmap_power(table.column("largest")[0].as_py())
        bits = np.stack([np.frombuffer(bitmap(s, power), np.uint8) for s in _sets(table)]).view(U64)
        size, component = table.column("size").to_numpy(), table.column("component").to_numpy()
        excess = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        row = {"hub": table.column("hub")[0], "node": table.column("node")[0], "out": table.column("out")[0], "bits": np.bitwise_or.reduce(bits, 0).tobytes(), "low": size.min(), "high": size.max(), "excess": excess.max(), "one": component.min(), "other": component.max()}
        return pa.table({k: [v.as_py() if isinstance(v, pa.Scalar) else v if isinstance(v, bytes) else int(v)] for k, v in row.items()})

    known = durable(nodes.join(sets.select("key", "shingles"), "key").groupBy("hub", "node").applyInArrow(summary, "hub long, node string, out boolean, bits binary, low long, high long, excess long, one long, other long"))
    left = known.where("out").select("hub", *(F.col(c).alias(f"x_{c}") for c in known.columns if c != "hub"))
    pairs = left.join(known, "hub").where("(NOT out OR x_node <= node) AND (x_one <> one OR x_other <> other OR one <> other)").where(100 * F.least("x_high", "high") >= percent * F.greatest("x_low", "low"))

    def bound(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            both = np.array([int(np.bitwise_count(np.frombuffer(x.as_buffer(), U64) & np.frombuffer(y.as_buffer(), U64)).sum()) for x, y in zip(column("x_bits"), column("bits"), strict=True)], dtype=np.int64)
            number = {c: column(c).to_numpy() for c in ("x_low", "x_excess", "low", "excess")}
            need = -(-percent * (number["x_low"] + number["low"]) // (100 + percent))
            keep = pa.array(np.flatnonzero(both + np.minimum(number["x_excess"], number["excess"]) >= need))
            yield pa.RecordBatch.from_arrays([column(c).take(keep) for c in ("hub", "x_node", "node")], names=["hub", "x", "y"])

    open_pairs = durable(pairs.select("hub", "x_node", "node", "x_bits", "bits", "x_low", "low", "x_excess", "excess").mapInArrow(bound, "hub long, x string, y string"))
    sides = open_pairs.select("hub", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("node"))

    def across(key, table):
        node = np.array(table.column("node").to_pylist(), dtype=object)
        keys = table.column("key").to_numpy().view(U64)
        members = Members(keys, _sets(table), table.column("component").to_numpy(), percent, kind)
        x, y = (np.flatnonzero(node == k.as_py()) for k in key[1:])
        if len(x) and len(y):
            members.join(x, None if key[1].as_py() == key[2].as_py() else y)
        return members.edges()

    both = sides.join(nodes.select("hub", "node", "key", "component"), ["hub", "node"]).join(sets.select("key", "shingles"), "key")
    return both.groupBy("hub", "x", "y").applyInArrow(across, "a long, b long")


def linked_groups(docs: DataFrame, profile: DataFrame, groups: DataFrame, n: int, percent: int, kind: type[SignatureTree] = SignatureTree) -> DataFrame:
    """docs (doc_id, text), their profile (doc_id, n_shingles, set_key) and groups (hub, key) of classes, the hub included, in which links are looked for ->
    (doc_id, n_shingles, component_id)."""
    classes = profile.where("n_shingles > 0").groupBy(F.col("set_key").alias("key")).agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
    wanted = durable(classes.join(groups.select("key").distinct(), "key", "left_semi"))
    sets = durable(sets_of(docs, wanted.select("key", "doc_id"), n)).select("key", "shingles")
    members = groups.join(wanted.select("key", "size"), "key")
    nodes = durable(cut_into_nodes(members, ["hub"], whole=True))
    hubs = nodes.select("hub", "band", "salt").distinct()
    every = nodes.where("key <> hub").select("hub", "band", "salt", "key").union(hubs.select("*", F.col("hub").alias("key")))
    links = durable(joined_nodes(every, sets, percent, kind))
    labels = connected_components(links)
    cut = nodes.where("band >= 0").join(labels.withColumnRenamed("node", "key"), "key", "left").select("hub", "key", "size", F.coalesce("component", "key").alias("component"))
    more = crossing_links(durable(cut), sets, percent, kind)
    if more is not None:
        links = durable(links.union(more))
        labels = connected_components(links)

    labelled = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = labelled.join(least, "component").select(F.col("key").alias("set_key"), "component_id")
    joined = profile.where("n_shingles > 0").join(of_class, "set_key").select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(profile.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicate_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, kind: type[SignatureTree] = SignatureTree) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links reach, the document's own included; kind is the tree that joins nodes."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    profile = durable(set_profile(docs, n))
    largest = profile.agg(F.max("n_shingles")).first()[0] or 0
    return linked_groups(docs, profile, durable(subtrees(durable(blocks(docs, n, percent, largest)))), n, percent, kind)


def op5_jaccard_join(spark, sf_dir):
    from veritome.llm.runtime import table

    return near_duplicate_groups(table(spark, sf_dir, "documents"))

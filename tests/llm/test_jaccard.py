import random

import numpy as np
import pytest

from tests.llm.brute import groups
from veritome.llm import jaccard
from veritome.llm.jaccard import Members, Ranges, SignatureTree, bitmap, folded, near_duplicate_groups
from veritome.llm.text import dealt

SCHEMA = "doc_id long, text string, note string"


def check(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_groups(df, **options).collect()}
    assert got == groups(rows)


def test_random_near_copies(spark):
    random.seed(3)
    rows, word = [], lambda: random.choice("abcdefghijklmnop") + random.choice("xyzuv")
    for base in range(14):
        text = [word() for _ in range(random.choice((3, 6, 9, 12, 20, 40, 90, 300)))]
        for copy in range(9):
            own = list(text)
            for _ in range(random.randrange(0, 1 + len(own) // 25 + (copy % 3))):
                own[random.randrange(len(own))] = word()
            rows.append((base * 100 + copy, " ".join(own)))
    random.shuffle(rows)
    check(spark, rows)


def test_threshold_is_inclusive_and_chains(spark):
    a = [f"w{i}" for i in range(13)]  # 9 shingles
    rows = [(5, " ".join(a)), (4, " ".join(a[1:] + ["x"])), (3, " ".join(a[2:] + ["x", "y"])), (9, " ".join(a[:12]))]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a " * 30), (8, "A " * 31), (9, "É é"), (10, "é é")]
    check(spark, rows)
    repeated = spark.createDataFrame([(1, "a b c d e f", "n"), (1, "a b c d e f", "n"), (None, "a b c d e f", "n"), (None, None, "n")], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_groups(repeated).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None)], key=str)
    assert near_duplicate_groups(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("tile", [2, 4096])
def test_blocks_that_stay_open_go_through_trees(spark, monkeypatch, tile):
    """Sets that share half of their words meet in blocks and don't link; tiles of two members split every block."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    random.seed(8)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"u{i}_{j}" for j in range(8 + i % 5)])) for i in range(24)]
    rows += [(100 + i, " ".join(common[: 50 + i] + ["z"] * 3)) for i in range(12)]
    check(spark, rows)


def test_linked_sets_share_a_signature():
    random.seed(1)
    ranges = Ranges(80, 3000)
    for _ in range(300):
        n = random.choice((4, 5, 6, 8, 11, 17, 40, 200, 900))
        a = np.unique(np.array([random.getrandbits(64) for _ in range(n)], np.uint64))
        change = random.randrange(0, 1 + 2 * n // 9)
        keep = a[: len(a) - change // 2]
        b = np.unique(np.r_[keep, np.array([random.getrandbits(64) for _ in range(change - change // 2)], np.uint64)])
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            (x, tx), (y, ty) = ranges.signatures(a), ranges.signatures(b)
            both = set(x.tolist()) & set(y.tolist())
            assert both
            enough = {int(t) >> 24 for t in tx if sum(int(u) == int(t) and v in both for v, u in zip(x.tolist(), tx, strict=True)) >= (int(t) & 0xFFFFFF)}
            assert enough & {int(t) >> 24 for t in ty if sum(int(u) == int(t) and v in both for v, u in zip(y.tolist(), ty, strict=True)) >= (int(t) & 0xFFFFFF)}


def test_tree_loses_no_pair():
    random.seed(2)
    values = [np.array([random.getrandbits(64) for _ in range(60)], np.uint64) for _ in range(4)]
    sets = [np.unique(np.r_[v[: 60 - k], np.array([random.getrandbits(64) for _ in range(k)], np.uint64)]) for v in values for k in range(12)]
    maps = folded([np.frombuffer(bitmap(s), np.uint8) for s in sets])
    tree = SignatureTree(maps, np.array([len(s) for s in sets]), np.arange(len(sets)))
    found = {tuple(sorted(p)) for p in tree.pairs(tree, 80).tolist()}
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= found and len(found) < len(sets) * (len(sets) - 1) / 4


def test_without_trees_there_are_no_links(monkeypatch):
    random.seed(6)
    common = [random.getrandbits(64) for _ in range(200)]
    sets = [np.unique(np.array(common[: 195 - i] + [random.getrandbits(64) for _ in range(5 + i)], np.uint64)) for i in range(8)]
    keys = np.array([jaccard.fingerprint(s) for s in sets], np.uint64)
    join = lambda: Members(keys, sets, np.arange(8), 80)
    members = join()
    members.join(np.arange(8))
    assert len(members.edges()) == 7
    monkeypatch.setattr(SignatureTree, "pairs", lambda *_: np.zeros((0, 2), np.int64))
    members = join()
    members.join(np.arange(8))
    assert len(members.edges()) == 0


@pytest.mark.parametrize(("tile", "shingles"), [(4, 1 << 21), (1024, 400)])
def test_components_that_cross_nodes(spark, monkeypatch, tile, shingles):
    """Chains and stars within one subtree, cut into many nodes; what the hub doesn't connect is found across nodes."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "SHINGLES", shingles)
    random.seed(9)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(base[: 80 - 3 * i] + [f"c{j}" for j in range(3 * i)])) for i in range(9)]
    rows += [(50 + i, " ".join(base[:40] + [f"d{i % 3}_{j}" for j in range(30 + i // 3)])) for i in range(6)]
    random.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("led", [1, 2])
def test_leaders_and_their_followers(spark, monkeypatch, led):
    """Where only leaders are sent, no link of those that follow them is lost."""
    monkeypatch.setattr(jaccard, "LED", led)
    random.seed(5)
    bases = [[f"b{k}_{i}" for i in range(60)] for k in range(3)]
    rows = []
    for i in range(36):
        own = list(bases[i % 3])
        for _ in range(random.randrange(0, 3)):
            own[random.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    check(spark, rows)


def test_dealt_columns_keep_their_entries():
    bucket = np.array([2, 0, 1, 2, 0], np.int64)
    mask = np.array([True, False, True, True, False])
    row = dealt(bucket, [np.arange(5, dtype=np.uint32), (np.array([10, 11, 12], np.uint64), mask)], ["a", "b"]).to_pylist()
    assert [r["bucket"] for r in row] == [0, 1, 2]
    assert [np.frombuffer(r["a"], np.uint32).tolist() for r in row] == [[1, 4], [2], [0, 3]]
    assert [np.frombuffer(r["b"], np.uint64).tolist() for r in row] == [[], [11], [10, 12]]


class Blind(SignatureTree):
    """A tree whose traversal finds no pairs."""

    def pairs(self, other, percent):
        return super().pairs(other, percent)[:0]


def test_every_link_between_different_sets_comes_from_the_trees(spark):
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"u{i}"] * (i % 4))) for i in range(40)]
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(df).collect()}
    assert set(got.values()) == {0}
    texts = {}
    for d, t in rows:
        texts.setdefault(t, d)
    assert {r.doc_id: r.component_id for r in near_duplicate_groups(df, kind=Blind).collect()} == {d: texts[t] for d, t in rows}

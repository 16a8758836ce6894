import random

import numpy as np
import pytest

from tests.llm.brute import groups
from veritome.llm import jaccard
from veritome.llm.superminhash import SLOTS, bands, signatures, superminhash_groups

SCHEMA = "doc_id long, text string, note string"


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in superminhash_groups(df).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in groups(rows, n=2).items()}


def sets(*values):
    return np.concatenate(values), np.r_[0, np.cumsum([len(v) for v in values])]


def hashes(n, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 63, n).astype(np.uint64)


def plain(values, slots):
    """Slot by slot and element by element, without early stopping."""
    got = signatures(*sets(*[np.array([v], np.uint64) for v in values]), slots)
    return got.min(0)


@pytest.mark.parametrize("n", [1, 2, 5, 30, 400])
def test_early_stopping_changes_nothing(n):
    values = hashes(n, n)
    assert (signatures(*sets(values), 31)[0] == plain(values, 31)).all()


def test_an_element_has_each_rank_once():
    one = signatures(*sets(hashes(1)))[0]
    assert sorted((one >> np.uint64(48)).tolist()) == list(range(SLOTS))


@pytest.mark.parametrize("size", [10, 40, 1000])
def test_shares_of_equal_slots_estimate_the_index_with_less_variance(size):
    """Independent minima would have a variance of J * (1 - J) / SLOTS; a small set's is well below."""
    got, shared = [], size * 8 // 10
    for seed in range(150):
        v = hashes(size * 2 - shared, 100 + seed)
        a, b = signatures(*sets(v[:size], np.r_[v[:shared], v[size:]]))
        got.append((a == b).mean())
    index = shared / (2 * size - shared)
    spread = np.var(got) / (index * (1 - index) / SLOTS)
    assert abs(np.mean(got) - index) < 0.01 and spread < (0.75 if size < SLOTS else 1.4)


def test_bands_of_linked_sets_meet():
    for size in (5, 9, 45, 450):
        missed = 0
        for seed in range(60):
            v = hashes(size, seed)
            a, b = bands(signatures(*sets(v, v[: -(size // 5)])))
            missed += not (a == b).any()
        assert not missed


def test_random_near_copies(spark):
    random.seed(3)
    rows, word = [], lambda: random.choice("abcdefghijklmnop") + random.choice("xyzuv")
    for base in range(14):
        text = [word() for _ in range(random.choice((1, 2, 3, 6, 9, 20, 40, 90, 300)))]
        for copy in range(9):
            own = list(text)
            for _ in range(random.randrange(0, 1 + len(own) // 20 + (copy % 3))):
                own[random.randrange(len(own))] = word()
            rows.append((base * 100 + copy, " ".join(own)))
    random.shuffle(rows)
    check(spark, rows)


def test_small_nodes(spark, monkeypatch):
    """A group of near copies that is cut into nodes of two, and sets that share a band without a link."""
    monkeypatch.setattr(jaccard, "TILE", 2)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"u{i}_{j}" for j in range(i % 9)])) for i in range(20)] + [(50 + i, " ".join(common + [f"v{i}_{j}" for j in range(30)])) for i in range(8)]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a " * 30), (8, "A " * 31), (9, "É é"), (10, "é é"), (11, "one two " * 20_000)])
    repeated = spark.createDataFrame([(1, "a b c", "n"), (1, "a b c", "n"), (None, "a b c", "n"), (None, None, "n")], SCHEMA).withColumnRenamed("note", "hub")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in superminhash_groups(repeated).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)], key=str)
    assert superminhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []

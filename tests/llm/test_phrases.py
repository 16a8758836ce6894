import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from veritome.llm import oracles, phrases
from veritome.llm.phrases import Grams, collocations, frequent_phrases, verified_groups

SCHEMA = "doc_id long, text string, lang string, size string"


def plain(rows, **limits):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string())}))
    return sorted(con.execute(oracles.op12(**limits)).df()[["lang", "rank", "phrase", "a", "l", "r", "n", "score"]].itertuples(index=False, name=None))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)


def made(seed, n=120):
    random.seed(seed)
    words, marks = ["the", "of", "New", "new", "York", "é", "É", "a" * 70, "a" * 70 + "b", "\u00a0", "in", "1"], [" ", "  ", "\t", ". ", ",", "\n", " ; ", "\r\n"]
    fixed = ["new York city hall", "in spite of the", "a b c d e"]
    out = []
    for i in range(n):
        parts = [random.choice(fixed) if random.random() < 0.3 else random.choice(words) for _ in range(random.randrange(0, 60))]
        out.append((i, "".join(p + random.choices(marks, [20, 2, 1, 2, 2, 1, 1, 1])[0] for p in parts), random.choice(["en", "en", "fr", None, "und"])))
    return out


@pytest.mark.parametrize("bits", [64, 9])
def test_brute_force(spark, bits):
    """With 9 bits a fingerprint stands for many phrases, which only their text tells apart."""
    rows = made(1) + [(7, "new york " * 40, "fr"), (7, "new york " * 40, "fr"), (None, "in in in", None), (None, None, "en"), (900, "", "de"), (901, " .\n", "de")]
    got = sorted(tuple(r) for r in collocations(frame(spark, rows), least=5, bits=bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got and got == plain(rows, least=5)


def test_small_filters_change_nothing(spark, monkeypatch):
    """A bitmap that is nearly full lets nearly everything through; tasks that pass on their counts at once."""
    monkeypatch.setattr(phrases, "FILTER", 8)
    monkeypatch.setattr(phrases, "HELD", 10)
    rows = made(2)
    got = sorted(tuple(r) for r in collocations(frame(spark, rows), least=8, top=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got and got == plain(rows, least=8, top=3)


def test_no_rows_and_no_words(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in frequent_phrases(frame(spark, [(1, None, None), (2, "", "en")])).orderBy("lang").collect()] == [("en", 0, "", 0), ("und", 0, "", 0)]


def test_fingerprints_are_those_of_the_words():
    texts = pa.array(["one two three. two  three", None, "", "Two\tthree", "two, three"])
    grams = Grams(texts, np.zeros(5, np.int64), 64)
    at = grams.whole(2)
    found = dict(zip(at.tolist(), grams.fingerprints(at, 2).tolist()))
    assert sorted(found) == [0, 1, 3, 5] and found[1] == found[3] == found[5] != found[0]
    other = Grams(texts, np.ones(5, np.int64), 64)
    assert not set(other.fingerprints(at, 2).tolist()) & set(found.values())


def test_collisions_are_told_apart():
    grams = Grams(pa.array(["a b a b c b A  B"]), np.zeros(1, np.int64), 64)
    at = grams.whole(2)
    first, counts = verified_groups(grams, at, 2, np.zeros(len(at), np.uint64), np.zeros(1, np.int64))
    assert sorted(zip(first.tolist(), counts.tolist())) == [(0, 3), (1, 2), (3, 1), (4, 1)]

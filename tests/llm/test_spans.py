import random

import numpy as np
import pytest

from tests.llm.brute import deduped
from veritome.llm.spans import dedup_digest, factors, leftmost_minimum, longest_matches, repeated_anchors, without_repeats

SCHEMA = "doc_id long, text string, row long"


def digests(spark, rows, n=35):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_digest(df, n=n).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 5, 35])
def test_planted_passages(spark, n):
    random.seed(n)
    word = lambda: random.choice("abcdefgh") * random.randrange(1, 4)
    passages = [[word() for _ in range(random.choice((n - 1, n, n + 1, 2 * n, 3 * n + 1)))] for _ in range(6)]
    rows = []
    for i in range(30):
        ws = []
        for _ in range(random.randrange(0, 4)):
            ws += [f"u{random.getrandbits(40)}" for _ in range(random.randrange(0, 20))] + random.choice(passages)
        rows.append((i, " ".join(ws)))
    assert digests(spark, rows, n) == sorted(deduped(rows, n), key=str)


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a " * 36), (5, long), (6, long + " x"), (6, long + " x"), (7, "É " * 35), (8, long.upper())]
    assert digests(spark, rows) == sorted(deduped(rows), key=str)
    assert dedup_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_keep_their_blanks_and_columns(spark):
    passage = "\n".join(f"p{i}" for i in range(35))
    df = spark.createDataFrame([(1, f"one\n two {passage} three\tfour", 7), (2, f"{passage}\n", 8), (3, None, 9)], SCHEMA)
    out = without_repeats(df)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.row) for r in out.collect()} == {1: ("one\n two three\tfour", 7), 2: ("", 8), 3: (None, 9)}


def test_factors_name_a_source(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    texts = spark.createDataFrame([(11, f"a b {passage} c"), (12, f"{passage} d")], "row long, text string")
    got = sorted(factors(texts).collect())
    words = {11: f"a b {passage} c".split(), 12: f"{passage} d".split()}
    covered = {11: set(), 12: set()}
    for f in got:
        assert words[f.row][f.start : f.start + 35] == words[f.source_row][f.source_start : f.source_start + 35]
        assert (f.row, f.start) != (f.source_row, f.source_start)
        covered[f.row] |= set(range(f.start, f.stop))
    assert covered == {11: set(range(2, 52)), 12: set(range(50))}


def test_leftmost_minimum():
    random.seed(4)
    for w in (1, 2, 3, 5, 24):
        v = np.array([random.randrange(5) for _ in range(60)], np.uint64)
        assert leftmost_minimum(v, w).tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(61 - w)]


def test_factors_match_their_sources_word_for_word(spark):
    """Of passages that overlap, repeat within a text, and continue in different sources."""
    random.seed(11)
    passage = [f"p{i % 90}_{i // 90}" for i in range(200)]
    rows = []
    for i in range(24):
        a = random.randrange(0, 150)
        ws = [f"u{i}_{j}" for j in range(random.randrange(0, 9))] + passage[a : a + random.randrange(3, 60)] + [f"v{i}"] + passage[: random.randrange(0, 12)] * 2
        rows.append((i, " ".join(ws)))
    rows += [(40, "a " * 30), (41, rows[0][1])]
    n, words = 5, {d: t.split() for d, t in rows}
    covered = {d: set() for d in words}
    for f in factors(spark.createDataFrame(rows, "row long, text string").repartition(3), n).collect():
        assert f.stop - f.start >= n and (f.row, f.start) != (f.source_row, f.source_start)
        assert words[f.row][f.start : f.stop] == words[f.source_row][f.source_start : f.source_start + f.stop - f.start]
        covered[f.row] |= set(range(f.start, f.stop))
    assert {d: len(c) for d, c in covered.items()} == {d: gone for d, _, gone, _ in deduped(rows, n)}


def test_longest_matches():
    random.seed(12)
    texts = [[random.randrange(3) for _ in range(random.randrange(1, 30))] for _ in range(12)]
    symbols = np.array([x for t in texts for x in t], np.uint64)
    left = np.array([len(t) - i for t in texts for i in range(len(t))])
    suffix = [symbols[i : i + k].tolist() for i, k in enumerate(left)]
    length, source = longest_matches(symbols, left)

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    for i, s in enumerate(suffix):
        assert length[i] == max(common(s, t) for j, t in enumerate(suffix) if j != i) == common(s, suffix[source[i]]) and source[i] != i


def test_repeated_rows_take_linear_space(spark):
    size = []
    for copies in (50, 100):
        rows = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(200)))] * copies, "row long, text string").repartition(4)
        size.append(sum(len(r.places) for r in repeated_anchors(rows, 35).collect()))
        assert {(f.row, f.start, f.stop, f.source_row, f.source_start) for f in factors(rows, 35).collect()} == {(7, 0, 200, 7, 0)}
    assert size[0] == size[1]

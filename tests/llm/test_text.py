import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import shingles, words
from veritome.llm.text import dealt, gathered, sequence_hashes, shingle_sets, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab AÉé\t\n\v\f\r 0", max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.booleans())
def test_words_and_hashes(texts, lower):
    got = words_of(pa.array(texts, pa.string()), lower)
    want = [words(t, lower) for t in texts]
    assert got.counts().tolist() == [len(w) for w in want]
    flat, seen = [x for w in want for x in w], {}
    for x, h in zip(flat, got.hash.tolist(), strict=True):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [got.data[a:b].tobytes() for a, b in zip(got.start, got.end, strict=True)] == [x for t in texts for x in words(t, False)]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingle_sets(texts):
    got = list(shingle_sets(words_of(pa.array(texts, pa.string()), True)))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]


def test_slices_and_large_types():
    a = pa.array(["skip me", "one two", None, "three"])
    for kind in (pa.string(), pa.large_string()):
        assert words_of(a.cast(kind).slice(1, 3), False).counts().tolist() == [2, 0, 1]


def test_sequences_depend_on_order_and_place():
    h = np.arange(100, dtype=np.uint64)
    for n in (1, 2, 3, 5, 7, 12, 35, 100):
        s = sequence_hashes(h, n)
        assert len(s) == 101 - n and len(np.unique(s)) == len(s)
        assert (sequence_hashes(h[20:], n) == s[20:]).all() if n <= 80 else True
    assert len(sequence_hashes(h, 101)) == 0


def test_word_longer_than_a_block():
    text = "x" * (3 << 20) + " y"
    assert words_of(pa.array([text, "y"]), True).hash[1:].tolist() == [words_of(pa.array(["y"]), True).hash[0]] * 2


def test_words_of_structured_bytes_have_hashes_of_their_own():
    """Thue-Morse words and their complements collide under polynomials modulo powers of two."""
    texts = []
    for power in range(3, 13):
        bits = [bin(i).count("1") % 2 for i in range(1 << power)]
        texts += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    texts += ["a" * n for n in range(1, 200)] + ["a" * 70 + "\0" * n for n in range(1, 4)]
    got = words_of(pa.array(texts, pa.string()), True).hash
    assert len(got) == len(texts) == len(np.unique(got))
    assert words_of(pa.array([t.upper() for t in texts], pa.string()), True).hash.tolist() == got.tolist()


def test_dealt_columns_come_back_with_and_without_planes():
    rng = np.random.default_rng(3)
    bucket = rng.integers(0, 5, 1000)
    columns = [rng.integers(0, 1 << 63, 1000).astype(np.uint64), rng.integers(-9, 9, 1000), rng.integers(0, 200, 1000).astype(np.uint8), rng.integers(0, 1 << 31, 1000).astype(np.uint32)]
    order = np.argsort(bucket, kind="stable")
    for planes in (False, True):
        table = pa.Table.from_batches([dealt(bucket, columns, list("abcd"), planes)])
        assert table.num_rows == 5
        for name, column in zip("abcd", columns, strict=True):
            assert np.array_equal(gathered(table, name, column.dtype, planes), column[order])
        assert gathered(table.slice(0, 0), "a", np.uint64, planes).tolist() == []
        assert pa.Table.from_batches([dealt(bucket[:0], [c[:0] for c in columns], list("abcd"), planes)]).num_rows == 0

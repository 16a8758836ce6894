import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritome.llm import alignment
from veritome.llm.alignment import FOLDER, Parts, aligned, gallop, token_alignment, vocabularies
from veritome.llm.text import _buffers

PATHS = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
ODD = ["<|endoftext|>", "</s> <s>", "<0x41>", "  ", "\t", "\r\n", " ", "▁", "　", "\u0085", "\x1c", "\x00", "é", "ß", "日本", "😀", "'s", " 's", "12345", "***", "a", "the", "word", "ing", "é", "ﬁ"]


def tokens(text):
    """Pairs (id, bytes) of A and of B for the whole text at once."""
    v = vocabularies(*PATHS)
    a, b = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
    return [(i, v.a_bytes[i]) for i in a], [(i, v.b_bytes[i]) for i in b]


def plain(rows):
    """What the operator returns, token by token."""
    parts, counts = [], Counter()
    for d, text in rows:
        a, b = tokens(text) if text else ([], [])
        want = b" " + (text or "").encode()
        if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, t in side:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        links = [(i, j) for i, s, e in spans[0] for j, x, y in spans[1] if s < y and x < e]
        counts.update(links)
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = ";".join("|".join(",".join(str(i) for i, _, e in side if low < e <= high) for side in spans) for low, high in zip([0, *common], common))
        parts.append((d, len(a), len(b), len(common), links, groups))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return sorted(((d, n_a, n_b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if s else "") for d, n_a, n_b, g, links, s in parts), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in token_alignment(df).collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.sampled_from([" ", " ", "x", "Of", "thé"]), st.characters(codec="utf-8")), max_size=25).map("".join), st.text(alphabet="ab é 　\n ", max_size=20))
def test_parts_have_the_tokens_of_the_whole_text(text, more):
    for texts in ([text, more], [more, None, text, ""]):
        got, v = aligned(pa.array(texts, pa.string()), Parts(vocabularies(*PATHS))), vocabularies(*PATHS)
        at_a, at_b = 0, got.n_a
        for t, n_a, n_b in zip(texts, *got.numbers):
            a, b = tokens(t) if t else ([], [])
            if b"".join(x for _, x in a) != b" " + (t or "").encode() or b"".join(x for _, x in b) != b" " + (t or "").encode():
                a, b = [], []
            assert got.ids[at_a : at_a + n_a].tolist() == [i for i, _ in a] and got.ids[at_b : at_b + n_b].tolist() == [i for i, _ in b]
            at_a, at_b = at_a + n_a, at_b + n_b
    assert v.cuts


def test_gallop():
    rng = np.random.default_rng(2)
    longer, ends, place, low, high = [], [], [], [], []
    for size in (1, 2, 3, 50, 700, 20_000):
        values = np.cumsum(rng.integers(1, 9, size))
        own = np.unique(np.r_[rng.choice(values[-1], max(1, size // rng.integers(1, 40))), values[-1]])
        low += [len(np.concatenate(longer)) if longer else 0] * len(own)
        high += [low[-1] + size] * len(own)
        place += range(len(own))
        longer.append(values)
        ends.append(own)
    longer, ends, low, high = np.concatenate(longer), np.concatenate(ends), np.array(low), np.array(high)
    want = [a + np.searchsorted(longer[a:b], e) for e, a, b in zip(ends, low, high)]
    assert gallop(ends, np.array(place), low, high, longer).tolist() == want


@pytest.mark.parametrize("block", [1, 1 << 24])
def test_brute_force(spark, monkeypatch, block):
    """Of blocks of a document each, and of a block a partition; repeated rows, null ids and texts, and a clashing column."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    random.seed(5)
    words = ["the", "of", "entrehe", "thonion", "Straße", "été", "x" * 90, *ODD]
    rows = [(i, "".join(random.choice((" ", " ", " ", "", "\n")) + random.choice(words) for _ in range(random.randrange(0, 60)))) for i in range(60)]
    rows += [(7, rows[3][1]), (None, "one two"), (None, "one two"), (90, None), (91, ""), (92, " "), (93, "  a "), (94, "a▁b"), (95, " the of" * 3000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, block int").repartition(3)
    assert result(df) == plain(rows)


def test_no_rows(spark):
    assert token_alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000")
    assert result(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])

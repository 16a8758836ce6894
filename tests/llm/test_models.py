import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import base_scores
from veritome.llm import brown, language, mixing, quality
from veritome.llm.brown import class_model_scores, exchange, op4_brown_classes
from veritome.llm.language import bucket, codewords
from veritome.llm.runtime import table
from veritome.llm.text import words_of

DOCS = "doc_id long, text string, lang string, source string"


def held(i, of, what=0):
    return zlib.crc32(str(i).encode()) % of == what


def prose(kind, n, seed):
    r = random.Random(seed)
    parts = {"xx": ["ka", "to", "mi", "ra", "no"], "yy": ["schu", "berg", "wald", "tz"], "zz": ["eau", "oux", "ille", "ée"]}[kind]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(i, prose(k, 30 + i % 50, i), k, "s") for i, k in enumerate(("xx", "yy", "zz") * 60)]
    rows += [(1000, None, "xx", "s"), (1001, "123 !!", "yy", "s"), (1002, prose("zz", 40, 5).upper(), None, "s"), (1003, "", None, "s")]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


def test_languages_of_held_out_texts(spark, languages):
    rows, df = languages
    model = language.fit(df.where(bucket(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language.predict(df.select("doc_id", "text"), model).collect()}
    assert all(got[i].lang_pred == k for i, _, k, _ in rows if i < 1000)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "zz", "und"]
    nothing = language.fit(df.where("lang IS NULL"))
    assert {r.lang_pred for r in language.predict(df.select("doc_id", "text"), nothing).collect()} == {"und"}


def test_codewords_are_apart():
    assert codewords(1).shape == (1, 1)
    for n in (2, 3, 4, 7, 8, 20):
        code = codewords(n)
        distance = (code.shape[1] - code @ code.T) / 2
        assert distance[np.triu_indices(n, 1)].min() >= max(1, code.shape[1] // 4)


def test_crc_of_ids(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    assert [r[0] for r in df.select(bucket(F.col("doc_id"), 5)).collect()] == [zlib.crc32(str(i).encode()) % 5 for i in range(50)] + [-1]


def test_quality_of_held_out_texts(spark):
    rows = []
    for i in range(300):
        good = prose("xx", 40, i).capitalize() + "."
        rows.append((i, good if i % 3 else (good.upper().replace(" ", "!! ") if i % 2 else " ".join([good.split()[0]] * 40)), "xx", "s"))
    rows += [(900, None, "xx", "s"), (901, " ", "xx", "s")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(300)] + [(3, None)], "doc_id long, label int")
    model = quality.fit(docs.select("doc_id", "text"), labels.where(bucket(F.col("doc_id"), 3) != 1))
    got = {r.doc_id: r for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    test = [i for i in range(300) if held(i, 3, 1)]
    assert np.mean([got[i].predicted == (1 if i % 3 else 0) for i in test]) > 0.97
    assert got[900].score == got[901].score == 0.0
    assert {r.score for r in quality.score(docs.select("doc_id", "text"), None).collect()} == {0.0, 0.5}


def test_cosines_are_exact_in_blocks(spark):
    random.seed(1)
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, (70, quality.TERMS)).astype(np.float32)
    model = quality.NeighbourModel(np.ones(quality.TERMS, np.float32), np.eye(quality.TERMS, 8, dtype=np.float32), np.zeros(0), (np.arange(40) % 2).astype(float), 5)
    model.vectors = model.latent(counts[:40])
    vectors = model.latent(counts)
    want = []
    for v in vectors:
        c = vectors[:40] @ v
        near = np.argsort(-c)[:5]
        w = np.maximum(c[near], 1e-6).astype(float) ** 8
        want.append((w * model.labels[near]).sum() / w.sum())
    assert np.allclose(model.scores(counts, block=16), want, atol=1e-5)


@pytest.mark.parametrize("kept", [1, 50, 65_536])
def test_base_scores_match_brute_force(spark, kept):
    rows = [(i, prose("xy"[i % 2] * 2, 5 + i % 30, i) + (" A B" if i % 3 else " É\n"), "l", "s") for i in range(120)] + [(500, None, "l", "s"), (501, "  ", "l", "s"), (502, "neverseen " * 3, "l", "s")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: r for r in class_model_scores(df, bucket(F.col("doc_id"), 10) == 0, kept=kept).collect()}
    for d, (n, known, total, base) in base_scores([(r[0], r[1]) for r in rows]).items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert sum(got[i].score for i in range(120) if held(i, 10)) > sum(got[i].base_score for i in range(120) if held(i, 10))


def every_word(blocks):
    """{hash: (count, class)} of a model's blocks."""
    out = {}
    for r in blocks.collect():
        h, c, own = (np.frombuffer(r[k], t) for k, t in (("hashes", np.uint64), ("counts", np.int64), ("classes", np.uint8)))
        out |= {int(x): (int(n), int(k)) for x, n, k in zip(h, c, own, strict=True)}
    return out


def test_class_model_is_a_distribution(spark, sf_dir):
    """Over all known words and one unknown for each class the probabilities after any history add up to 1."""
    m, blocks = brown.fit(table(spark, sf_dir, "documents").select("text"), frequent=50)
    known = np.array(list(every_word(blocks).values()))
    assert len(known) == m.words and known[:, 0].sum() == m.tokens
    mass = np.bincount(known[:, 1], 10 ** m.emission(known[:, 0].astype(float), known[:, 1]), brown.CLASSES) + 10 ** m.emission(np.zeros(brown.CLASSES), np.arange(brown.CLASSES))
    assert np.allclose(mass, 1) and np.allclose((10**m.transition).sum(1), 1)


@pytest.mark.parametrize("kept", [3, 65_536])
def test_class_scores_match_brute_force(spark, kept):
    """Word by word from the model's tables: each word's own class, and the class of the item before it."""
    rows = [(i, prose("xyz"[i % 3] * 2, 4 + i % 20, i) + (" A B" if i % 4 else " É"), "l", "s") for i in range(60)] + [(500, None, "l", "s"), (501, " ", "l", "s"), (502, "never seen ab " * 2, "l", "s")]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    docs = df.select("doc_id", F.lit(False).alias("held_out"), "text")
    m, blocks = brown.fit(df.where("doc_id < 500").select("text"), frequent=10, kept=kept)
    known, end = every_word(blocks), len(m.transition) - 1
    for r in brown.scored(docs, m, blocks).collect():
        words = words_of(pa.array([{d: t for d, t, _, _ in rows}[r.doc_id]], pa.string()), True)
        groups, want, before = brown.tail_groups(words), 0.0, end
        for h, g in zip(words.hash.tolist(), groups.tolist(), strict=True):
            n, own = known.get(h, (0, int(m.unseen[g])))
            want += m.transition[before, own] + m.emission(np.array([n]), np.array([own]))[0]
            at = np.flatnonzero(m.histories.keys == np.uint64(h))
            before = m.histories.classes[at[0] if len(at) else len(m.histories.keys) + g]
        want += m.transition[before, end] + m.emission(np.array([m.ends]), np.array([end]))[0]
        assert r.score == pytest.approx(want, rel=1e-9)


def test_exchange_gives_every_word_its_class(spark):
    """Words of two kinds that alternate are told apart, rare ones as well; equally frequent words beyond the room are told by hash."""
    r = random.Random(4)
    left, right = [f"l{r.getrandbits(30)}" for _ in range(150)], [f"r{r.getrandbits(30)}" for _ in range(150)]
    text = " ".join(f"{r.choice(left)} {r.choice(right)}" for _ in range(2700))
    df = spark.createDataFrame([(text,)], "text string")
    m, blocks = brown.fit(df, frequent=220, classes=4, kept=100)
    known = every_word(blocks)
    of = lambda ws: np.bincount([known[int(h)][1] for h in words_of(pa.array([" ".join(ws)]), True).hash], minlength=4)
    assert np.minimum(of(left), of(right)).sum() < 30
    words, times, _ = brown.most_frequent(brown.word_counts(df), 100)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    want = sorted((h for h in known if h), key=lambda h: (-known[h][0], signed(h)))[:100]
    assert len(m.kept) == 100 and words.tolist() == sorted(want)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c", "l", "s"), (1, "a b c", "l", "s"), (None, "a", "l", "s")], DOCS)
    got = class_model_scores(df, F.lit(False)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in got) == [("1", 4, 4), ("1", 4, 4), ("None", 2, 2)]
    empty = spark.createDataFrame([], DOCS)
    assert class_model_scores(empty, F.lit(False)).collect() == []
    assert language.predict(empty.select("doc_id", "text"), language.fit(empty)).collect() == []
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert quality.score(empty.select("doc_id", "text"), quality.fit(empty, labels)).collect() == []
    assert mixing.target_rates(empty, spark.createDataFrame([], "doc_id long, domain string"), {"clean": 1.0}).collect() == []


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    kind = rng.integers(0, 3, 60)
    n = rng.poisson(np.where((kind[:, None] + 1) % 3 == kind[None, :], 20.0, 0.3))
    own = exchange(n, 5)

    def value(own):
        g = np.zeros((5, 5))
        np.add.at(g, (own[:, None], own[None, :]), n)
        f = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    first = np.arange(60) % 4
    first[-1] = 4
    assert own[-1] == 4 and value(own) > value(first)
    best = value(own)
    for w in range(59):
        for c in range(4):
            other = own.copy()
            other[w] = c
            assert value(other) <= best + 1e-6


def test_rates_meet_targets(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), mixing.labelled_domains(table(spark, sf_dir, "labels"))
    rows = mixing.target_rates(docs, labels, mixing.TARGETS).toPandas()
    tokens = rows.n_tokens.sum()
    assert (rows.rate >= 0).all() and np.allclose(rows[["p_clean", "p_low", "p_toxic"]].sum(1), 1)
    for d, share in mixing.TARGETS.items():
        assert (rows.rate * rows.n_tokens * rows[f"p_{d}"]).sum() == pytest.approx(share * 0.5 * tokens, abs=0.002 * tokens)
    with pytest.raises(ValueError):
        mixing.target_rates(docs, labels, {"unheard": 1.0})


def test_op4_improves_on_the_base(spark, sf_dir):
    rows = op4_brown_classes(spark, sf_dir).where("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum()


def test_exchange_runs_until_nothing_moves():
    """Twelve passes aren't enough for this matrix; no move of one item raises the likelihood of the result."""
    classes, n = 8, np.random.default_rng(0).poisson(0.5, (400, 400)).astype(float)
    own = exchange(n, classes)
    f = lambda x: (x * np.log(np.maximum(x, 1e-12))).sum()

    def value(z):
        g = z.T @ n @ z
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    z = np.eye(classes)[own]
    best = value(z)
    for w in range(len(n) - 1):
        for c in range(classes - 1):
            z[w] = np.eye(classes)[c]
            assert value(z) <= best + 1e-6
        z[w] = np.eye(classes)[own[w]]


def test_columns_named_like_results(spark):
    rows = [(i, prose("xy"[i % 2] * 2, 30, i), "xy"[i % 2], float(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = language.predict(docs.withColumn("lang_pred", F.lit("q")).withColumn("ambiguous", F.lit(1)).withColumn("a b.c", F.lit(2)), language.fit(docs))
    assert sorted(out.columns) == ["a b.c", "ambiguous", "doc_id", "lang", "lang_pred", "score"] and {r.lang_pred for r in out.collect()} == {"x", "y"}
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    out = quality.score(docs.withColumn("predicted", F.lit("q")), quality.fit(docs.select("doc_id", "text"), labels))
    assert sorted(out.columns) == ["doc_id", "lang", "predicted", "score"] and {r.predicted for r in out.collect()} <= {0, 1}
    mixed = mixing.target_rates(docs.withColumn("rate", F.lit(5)), spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "doc_id long, domain string"), {"a": 0.5, "b": 0.5})
    assert mixed.columns == ["doc_id", "n_tokens", "p_a", "p_b", "rate", "converged"]


def test_tied_neighbours_are_the_earlier_rows():
    rng = np.random.default_rng(5)
    vectors = np.repeat(rng.normal(size=(40, 6)), 20, axis=0).astype(np.float32)
    vectors /= np.sqrt((vectors**2).sum(1, keepdims=True))
    labels = rng.integers(0, 2, len(vectors)).astype(float)
    model = quality.NeighbourModel(np.ones(6, np.float32), np.eye(6, dtype=np.float32), vectors, labels, 30)
    counts = np.expm1(np.abs(rng.normal(size=(25, 6)))).astype(np.float32)
    cosine = model.latent(counts) @ vectors.T
    for got, c in zip(model.scores(counts), cosine, strict=True):
        near = sorted(range(len(c)), key=lambda i: (-c[i], i))[:30]
        weight = np.maximum(c[near], 1e-6).astype(float) ** 8
        assert got == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-9)


def test_languages_are_decoded_as_defined(spark, sf_dir):
    """The language of the least weighted loss, text by text."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs.select("doc_id", "text"), model).collect()}
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        margin = language._features(pa.array([r.text], pa.string()))[0] @ model.weights + model.intercepts
        loss = {name: sum(w * np.log1p(np.exp(-b * m)) for w, b, m in zip(model.bit_weights, word, margin, strict=True)) for name, word in zip(model.languages, model.code, strict=True)}
        share = {k: np.exp(min(loss.values()) - v) for k, v in loss.items()}
        best = max(share, key=share.get)
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(share[best] / sum(share.values()), abs=1e-4)


def test_samples_are_bounded(spark, monkeypatch):
    from veritome.llm import features

    monkeypatch.setattr(features, "SAMPLED", 40)
    df = spark.createDataFrame([(i, f"l{i % 20}", "some text") for i in range(2000)], "doc_id long, label string, text string")
    chosen = features.sampled(df, "label", F.col("doc_id"), 800)
    labels, rows = features.collected(chosen.select("label", "text"), language._features, "string")
    assert 0 < len(labels) == len(rows) <= 80
    labels, _ = features.collected(df.select("label", "text"), language._features, "string")
    assert len(labels) == 80


def test_rates_reach_the_optimum(spark):
    """The weighted squared misses are those of a long run of plain projected gradients, for targets that can be met and that can't; so they are where rates are stored in between."""
    rows = [(i, " ".join(f"{'abc'[i % 3]}{j % (5 + i % 7)}" for j in range(3 + i % 40))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, ("a", "b", "c")[i % 3]) for i in range(60)], "doc_id long, domain string")
    for targets in ({"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 1.0}, {"a": 0.3, "b": 0.3, "gone": 0.4}):
        out = mixing.target_rates(docs, labels, targets).toPandas()
        p, t, rate = out[["p_a", "p_b", "p_c"]].to_numpy(), out["n_tokens"].to_numpy().astype(float), out["rate"].to_numpy()
        gram = (p * t[:, None]).T @ p
        weight = 1 / np.maximum(np.diag(gram), max(0.01 * np.trace(gram), 1e-12))
        known = {d: v for d, v in targets.items() if d in "abc"}
        wanted = np.array([known.get(d, 0.0) for d in "abc"]) * sum(targets.values()) / sum(known.values()) * t.sum() * mixing.BUDGET
        cost = lambda r: float((weight * ((t * r) @ p - wanted) ** 2).sum())  # noqa: E731, B023
        best, step = np.full(len(t), mixing.BUDGET), 1 / np.linalg.eigvalsh(np.sqrt(weight)[:, None] * gram * np.sqrt(weight)).max()
        for _ in range(20_000):
            best = np.maximum(0, best - step * p @ (weight * ((t * best) @ p - wanted)))
        assert rate.min() >= 0 and cost(rate) <= cost(best) + 1e-3 * (weight * wanted**2).sum()
        assert out["converged"].nunique() == 1 and bool(out["converged"][0]) == bool((np.abs((t * rate) @ p - wanted) <= mixing.CLOSE * wanted.max() + 1e-9).all())
        assert ("p_gone" in out.columns) == ("gone" in targets)


def test_steps_of_the_rates_are_few_tasks(spark):
    """However many partitions the documents have, the tasks of a step are as many as the rows need, and the rates are the same."""
    rows = [(i, " ".join(f"{'abc'[i % 3]}{j % (5 + i % 7)}" for j in range(3 + i % 40))) for i in range(90)]
    labels = spark.createDataFrame([(i, ("a", "b", "c")[i % 3]) for i in range(60)], "doc_id long, domain string")
    docs, context, out, tasks = spark.createDataFrame(rows, "doc_id long, text string"), spark.sparkContext, [], []
    for parts in (1, 24):
        group = f"rates in {parts}"
        spread = docs.repartition(parts, "doc_id")
        spread.count()
        context.setJobGroup(group, group)
        try:
            frame = mixing.target_rates(spread, labels, {"a": 1.0}, steps=30)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        status = context.statusTracker()
        stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
        tasks.append(sum(i.numTasks for i in map(status.getStageInfo, stages) if i))
        out.append(sorted(map(tuple, frame.select("doc_id", "rate", "converged").collect())))
    assert tasks[1] < tasks[0] + 12 * 24, tasks
    assert [r[0] for r in out[0]] == [r[0] for r in out[1]] and np.allclose([r[1] for r in out[0]], [r[1] for r in out[1]])


def test_collected_features_are_those_of_the_texts(spark):
    """Rows come back whole, in order of label and digest, though only what isn't 0 is sent."""
    import hashlib

    from veritome.llm import features

    texts = ["", "some words", "other words, and more of them", "some words", "x"]
    df = spark.createDataFrame([(f"l{i % 2}", t) for i, t in enumerate(texts)], "label string, text string").repartition(3)
    labels, x = features.collected(df, mixing._features, "string")
    want = mixing._features(pa.array(texts, pa.string())).astype(np.float32)
    order = sorted(range(len(texts)), key=lambda i: (f"l{i % 2}", hashlib.blake2b(want[i].tobytes(), digest_size=16).digest()))
    assert labels == [f"l{i % 2}" for i in order] and np.array_equal(x, want[order])


def test_gains_are_worked_out_once_for_equal_pairs(monkeypatch):
    """A pass over many rare words takes logarithms of its different pairs of history and times only; the classes are those of pair by pair."""
    rng = np.random.default_rng(3)
    g, h, n = rng.integers(0, 5000, (32, 32)).astype(float), rng.integers(0, 32, 20_000), rng.integers(1, 4, 20_000).astype(float)
    want, seen, plain = brown._f(g[h] + n[:, None]) - brown._f(g[h]), [], brown._f
    monkeypatch.setattr(brown, "_f", lambda x: (seen.append(np.size(x)), plain(x))[1])
    assert np.array_equal(brown.gains(g, h, n), want) and np.array_equal(brown.gains(g, h[:99], n[:99]), want[:99])
    assert sum(seen) <= 32 * (96 + 32 + 2 * 99)


def test_distinct_words_and_added_times():
    words = words_of(pa.array(["b a A", None, "c b", ""], pa.string()), True)
    some, back, times = brown.distinct(words)
    assert some.hash.tolist() == sorted(set(words.hash.tolist())) and some.hash[back].tolist() == words.hash.tolist() and sorted(times.tolist()) == [1, 2, 2]
    assert brown.tail_groups(some)[back].tolist() == brown.tail_groups(words).tolist()
    codes, n = np.array([7, 2, 7, 0]), np.array([3, 1, 2, 5])
    for size in (8, 1000):
        found, total = brown.added(codes, n, size)
        assert found.tolist() == [0, 2, 7] and total.tolist() == [5, 1, 5]

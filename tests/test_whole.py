"""Queries do the whole job: on small tables whose missing parts would show."""

import json

import duckdb
import pytest

from tests.test_catalog import normal
from veritome.operators import chat, evals, ingest
from veritome.plans import catalog
from veritome.sources import tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def documents(texts):
    return [(i, t, "en", "s", len(t)) for i, t in texts.items()], DOCS


def test_every_line_of_every_document_is_a_claim(spark, folder):
    texts = {i: "\n".join(f"alarm severity number {i}77 of line {j}" for j in range(9 + i)) for i in (3, 10, 11)}
    d = folder(documents=documents(texts))
    lines = {(i, j + 1) for i, t in texts.items() for j in range(len(t.split("\n")))}
    cited = {(i, n): (str(i), str(i), str(i + 1), f"x{i}")[(n - 1) % 4] for i, n in lines}
    rows = catalog.QUERIES["citation_normalise_all"](spark, d).collect()
    assert {(r.query_id, r.n): r.citation for r in rows} == cited and len(rows) == len(lines)
    verdicts = {(r.query_id, r.n): r.supported for r in catalog.QUERIES["claim_verify_all"](spark, d).collect()}
    assert verdicts == {k: cited[k] == str(k[0]) for k in lines}
    share = lambda i, good: round(sum((cited[k] == str(i)) == good for k in lines if k[0] == i) / len(texts[i].split("\n")), 4)
    assert {r.query_id: r.ungrounded_rate for r in catalog.QUERIES["ungrounded_rate_all"](spark, d).collect()} == {i: share(i, False) for i in texts}
    assert {r.query_id: r.citation_accuracy for r in catalog.QUERIES["citation_accuracy_all"](spark, d).collect()} == {i: share(i, True) for i in texts}
    assert {r.query_id: r.total for r in catalog.QUERIES["verdict_summary_all"](spark, d).collect()} == {i: len(t.split("\n")) for i, t in texts.items()}
    assert {r.query_id: (r.valid, r.fabricated) for r in catalog.QUERIES["citation_validate_all"](spark, d).collect()} == {i: (False, ",".join(sorted({f"x{i}"} | ({str(i + 1)} - {*map(str, texts)})))) for i in texts}


def test_embedded_texts_equal_the_hashed_embedding(spark):
    rows = spark.createDataFrame([(1, "some words some"), (2, "gNB-CU x_y one"), (3, ""), (4, None), (5, "--")], "id int, t string")
    want = {r.id: r.e for r in rows.where("id < 3").select("id", tables.hashed_embedding("t").alias("e")).collect()}
    got = {r.id: r.vector for r in tables.embedded(rows, "id", "t").collect()}
    assert set(got) == {1, 2} and all(got[i] == pytest.approx(want[i]) for i in got)


def test_the_dense_list_reaches_fusion_and_the_gate(spark, folder):
    """Both lists of a question are full, and fused there are more candidates than one list has; a question without tokens has neither."""
    question = "alarm severity threshold counter handover"
    texts = {i: "alarm " * 40 + f"filler{i}" for i in range(30)} | {99: question + " " + " ".join(f"pad{j}" for j in range(3))} | {200 + i: f"other text {i}" for i in range(80)}
    d = folder(documents=documents(texts), benchmark=([(1, question), (2, "--")], "item_id long, text string"))
    rows = {r.query_id: r for r in catalog.QUERIES["retrieve_topn"](spark, d).collect()}
    assert rows[1].dense_hits == 25 and rows[1].bm25_hits == 25 and rows[1].fused_candidates > 25 and "99" in json.loads(rows[1].chunk_ids)
    assert rows[2].dense_hits == rows[2].bm25_hits == 0
    assert {r.query_id: r.answerable for r in catalog.QUERIES["gate_confidence_hybrid"](spark, d).collect()} == {1: True, 2: False}


def test_all_turns_are_counted(spark, folder):
    turns = [(1, i, "user", "x") for i in range(6)] + [(8, 0, "user", "y")]
    d = folder(conversations=(turns, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: r.turns for r in catalog.QUERIES["conversation_list_all"](spark, d).collect()} == {1: 6, 8: 1}
    convs = spark.createDataFrame([(1, 1, 5), (9, 1, 4)], "conv_id long, visitor long, updated long")
    assert {r.conv_id: r.turns for r in chat.conversation_list(convs, spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()} == {1: 6, 9: 0}


def test_verdicts_and_replies_are_parsed_whole(spark, folder):
    late = 'A long reason of more than forty characters comes first. {"verdict": "SUPPORTED"}'
    text = 'alarm "one" is\nof severity {two}\n\ttab \\ three'
    d = folder(documents=documents({2: late} | {i: text for i in (3, 4, 5, 6, 7, 8, 9)}))
    labels = {r.doc_id: r.label for r in catalog.QUERIES["verdict_parse"](spark, d).collect()}
    assert labels[2] == "SUPPORTED" and labels[3] == "SUPPORTED" and labels[4] == "NOT_SUPPORTED"
    rows = {r.query_id: r for r in catalog.QUERIES["parse_claims_all"](spark, d).collect()}
    for i in (5, 6, 7):
        assert rows[i].answer == text and [c["claim"] for c in json.loads(rows[i].claims)] == ['alarm "one" is', "of severity {two}", "tab \\ three"]
        assert not rows[i].parse_failed
    assert not rows[8].sufficient and [rows[i].parse_failed for i in (4, 8, 9)] == [True, False, True]


def test_short_items_find_their_documents(spark, folder):
    texts = {1: "the alarm list of the cellular net", 2: "nothing of it", 3: "one alarm list"}
    items = {1: "alarm list", 2: "alarm list of the cell", 3: "the alarm list of the cellular", 4: "cell", 5: "absent words"}
    d = folder(documents=documents(texts), benchmark=(list(items.items()), "item_id long, text string"))
    got = sorted((r.query_id, r.gold) for r in catalog.QUERIES["gold_documents"](spark, d).collect())
    assert got == sorted((i, k) for i, q in items.items() for k, t in texts.items() if q in t)


def test_items_are_numbered_in_ranges(spark):
    rows = [(f"k{i * 7919 % 1000:04}", f"t{i}", i % 4 != 0, "p") for i in range(1000)]
    got = evals.renumbered(spark.createDataFrame(rows, "id string, text string, verified_by_human boolean, _private string").repartition(5))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    want = {f"G{n:03}": r[1] for n, r in enumerate(sorted(r for r in rows if r[2]), 1)}
    assert {r.id: r.text for r in got.collect()} == want and "_range" not in got.columns
    assert evals.renumbered(spark.createDataFrame([], got.schema)).count() == 0


def against_sql(spark, sf_dir, name, *needed):
    con = duckdb.connect()
    for t in needed:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert normal(got).equals(normal(want))


@pytest.mark.parametrize("name", ["chunk_summary", "clause_body", "clause_chunks", "successor_check", "heading_candidates", "heading_detect", "heading_path", "depth_histogram"])
def test_addresses_are_not_clauses(spark, folder, name):
    """Lines that begin with an IPv4 address, some of which would follow the heading before them plausibly."""
    texts = {1: "12.155.210.168 Reeding of the cells.\nsecond line of text\nthird line of text", 2: "first\n8.8.100.100  Anhaor heash.\nlast", 3: "no address here\n" * 5 + "end"}
    against_sql(spark, folder(documents=documents(texts)), name, "documents")


def test_clauses_of_four_levels_are_headings(spark):
    numbers = ["1.1.1.1", "4.3.126.1", "6.1.6.30", "22.4.3.1", "10.3.20.200", "25.300.40.2", "22.23.24.25.26", "30.40.50"]
    lines = spark.createDataFrame([(1, i, 1, f"{n} Title of it") for i, n in enumerate([*numbers, "56.187.231.175", "48.3.5.200"])], "doc_id long, line_no int, page int, line string")
    assert [r.num for r in ingest.heading_candidates(lines).orderBy("line_no").collect()] == numbers


@pytest.mark.parametrize("name", ["ungrounded_rate", "ungrounded_rate_all", "verdict_summary", "claim_verify", "claim_verify_batched"])
def test_accents_bound_words_of_a_negation(spark, folder, name):
    """As in SQL, `no` before an accented letter negates a claim, which its source, cut before it, doesn't."""
    words = [f"alarm{i} severity{i}" for i in range(6)]
    filler = "\n".join(["plain words of the net"] * 3 + [" ".join(words)] + ["filler " * 60] * 8)
    texts = {4: filler + "\n" + " ".join(words) + " noé", 5: "alarm\n" * 3 + "no alarm"}
    against_sql(spark, folder(documents=documents(texts)), name, "documents")


@pytest.mark.parametrize("name", ["ungrounded_rate", "verdict_summary"])
def test_rates_are_rounded_as_in_sql(spark, folder, name):
    """23 of 800 claims that name other words, 0.02875, and more such shares: the product with 10,000 tells which way they are rounded."""
    texts = {i * 4: "\n".join(f"other{j}x" if j < 400 + 2 * i + 1 and j % 4 < 2 else f"alarm{j % 7}x" for j in range(800)) for i in range(40)}
    d = folder(documents=documents(texts))
    against_sql(spark, d, name, "documents")


def test_accents_bound_words_of_an_intent(spark, folder):
    """As in SQL: `ue` before an accented letter is a word that the documents are about."""
    texts = ["En ez no ciónesezga lañllezga ueó cill.", "été, été", "ok ok", "hié there", "Ünr of all", "what about ité", "Kpi ſession of these", "plain words here that say little"]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)] + [(2, 0, "user", texts[0])]
    against_sql(spark, folder(conversations=(rows, "conv_id long, turn long, role string, text string")), "intent_classify", "conversations")

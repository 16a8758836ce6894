import random

import duckdb
import pytest

from tests.llm.brute import contained
from veritome.llm import oracles
from veritome.llm.decontaminate import contained_items, op10_decontaminate, without_contaminated

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def tables(spark):
    random.seed(6)
    word = lambda: random.choice("abcdefgh") + random.choice("qrstuvw")
    items = [(i, " ".join(word() for _ in range(random.choice((1, 4, 5, 9, 30, 80))))) for i in range(20)] + [(90, None), (91, " "), (92, "X y"), (93, "x Y")]
    docs = [(200, None), (201, ""), (202, "x y"), (203, "x y z")]
    for i in range(40):
        ws = [word() for _ in range(random.randrange(0, 200))]
        for _ in range(2):
            own = (random.choice(items)[1] or "").upper().split()
            for _ in range(random.randrange(0, 1 + len(own) // 20)):
                own[random.randrange(len(own))] = word()
            ws += own
        docs.append((i, " ".join(ws)))
    return docs, items, spark.createDataFrame([(*d, "n") for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, "n") for i in items], ITEMS)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_matches_brute_force(spark, limit):
    docs, items, d, i = tables(spark)
    want = contained(docs, items)
    assert len(want) > 20 and (203, 92, 1, 1) in want and (202, 92, 1, 1) in want
    assert sorted(tuple(r) for r in contained_items(d, i, broadcast_bytes=limit).select("doc_id", "item_id", "n_item_shingles", "n_shared").collect()) == want


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_repeated_and_empty(spark, limit):
    row = "one two three four five six"
    d = spark.createDataFrame([(1, row, "n"), (1, row, "n"), (None, row, "n")], DOCS)
    i = spark.createDataFrame([(5, row, "n")], ITEMS)
    assert sorted((str(r.doc_id), r.item_id) for r in contained_items(d, i, broadcast_bytes=limit).collect()) == [("1", 5), ("1", 5), ("None", 5)]
    assert contained_items(d, spark.createDataFrame([], ITEMS), broadcast_bytes=limit).count() == 0
    assert contained_items(spark.createDataFrame([], DOCS), i, broadcast_bytes=limit).count() == 0
    assert without_contaminated(d, i).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_short_items_inside_long_texts(spark, limit):
    filler = " ".join(f"w{i}" for i in range(3000))
    docs = [(1, f"{filler} alpha beta gamma {filler}"), (2, f"{filler} alpha beta {filler} gamma"), (3, "Beta\tgamma"), (4, "alpha"), (5, None)]
    items = [(10, "Alpha BETA gamma"), (11, "beta gamma"), (12, "alpha"), (13, " "), (14, "beta alpha"), (15, "w0 w1 w2 w3 w4 w5 w6")]
    d, i = spark.createDataFrame([(*x, "n") for x in docs], DOCS), spark.createDataFrame([(*x, "n") for x in items], ITEMS)
    got = sorted((r.doc_id, r.item_id) for r in contained_items(d, i, broadcast_bytes=limit).collect())
    assert got == [(1, 10), (1, 11), (1, 12), (1, 15), (2, 12), (2, 15), (3, 11), (4, 12)]


def test_sql_of_short_items(spark, tmp_path):
    """The query and its SQL on tables with items of one to seven words."""
    docs, items, d, i = tables(spark)
    unique = {key: text for key, text in items}
    d.drop("item_id").write.parquet(str(tmp_path / "documents.parquet"))
    i.drop("doc_id").where(i.item_id.isin(list(unique))).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(oracles.OP10).fetchall())
    got = sorted(tuple(r) for r in op10_decontaminate(spark, str(tmp_path)).select("doc_id", "item_id", "n_item_shingles", "n_shared").collect())
    assert got == want and any(len((unique[x[1]] or "").split()) < 5 for x in want)

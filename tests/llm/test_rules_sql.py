"""op7 and its SQL on tables where cutoffs reject documents that the base rules keep."""

import duckdb
import pytest

from veritome.llm import oracles
from veritome.llm.rules import CONFIDENCE, GRID, RISK, op7_risk_controlled


@pytest.fixture()
def folder(spark, tmp_path):
    docs, labels = [], []
    for i in range(6000):
        lang, good = ("aa", "bb", None)[i % 3], i % 20 not in (3, 4)
        noisy = not good or (lang == "bb" and i % 10 == 5) or (lang is None and i % 500 == 7)
        body = " ".join(f"w{i}x{j}" for j in range(30))
        docs.append((i, body + (" ###" if noisy else "") + ("\nsame line\nsame line" * 3 if not good and i % 40 == 3 else ""), lang))
        labels.append((i, int(good)))
    docs += [(9000, "w " * 5, "aa"), (9001, None, "aa"), (9002, docs[3][1], "cc"), (9003, "", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels + [(3, 1), (0, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_query_equals_its_sql_where_cutoffs_reject(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(oracles.op7(GRID, RISK, CONFIDENCE)).df()
    got = op7_risk_controlled(spark, folder).toPandas()[list(want.columns)]
    key = lambda f: sorted(f.astype(object).itertuples(index=False, name=None))
    assert key(got) == key(want)
    cut = want[~want.base_failed & ~want.kept]
    assert 200 < len(cut) < 1000 and not set(cut.doc_id) & {9002}

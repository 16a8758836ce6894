import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from veritome.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        frame[c] = frame[c].map(lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got).equals(normal(want))
    else:
        assert list(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("veritome/llm", "tests/llm"), ("veritome/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_works_without_the_llm_folders(tmp_path, gone):
    """Of a copy in which they are deleted, imported by another process."""
    root = Path(entry.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".*"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink()
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=False)
    n, ops, pipeline, covered = done.stdout.split() or pytest.fail(done.stderr)
    assert int(n) >= len(catalog.QUERIES) and ops == str("veritome/llm" not in gone) and pipeline == "False" and covered == "True"

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veritome.operators import ingest
from veritome.sources import tables
from veritome.streaming import events as streams


def test_chunk_table(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    assert tables.row_count(spark, path) == 0
    tables.append_chunks(rows, path, "base")
    tables.append_chunks(spark.createDataFrame([("s", "z")], rows.schema), path, "s1")
    with pytest.raises(ValueError):
        tables.append_chunks(rows, path, "s2")
    with pytest.raises(ValueError):
        tables.append_chunks(spark.createDataFrame([("q", "1"), ("q", "2")], rows.schema), path, "s2")
    own = tables.owned(spark, path, "s1")
    assert [r.chunk_id for r in own.collect()] == ["s"]
    assert "PartitionFilters: [owner" in own._jdf.queryExecution().toString().replace("isnotnull(owner#", "owner#") or "PartitionFilters" in own._jdf.queryExecution().toString()
    stay = {f: f.stat().st_mtime_ns for f in (tmp_path / "chunks").glob("owner=base/*")}
    assert tables.delete_owner(spark, path, "s1") == 1 and tables.delete_owner(spark, path, "s1") == 0
    assert stay == {f: f.stat().st_mtime_ns for f in (tmp_path / "chunks").glob("owner=*/*")}
    assert tables.row_count(spark, path) == 2


def test_owners_with_odd_names_and_the_last_one(spark, tmp_path):
    path = str(tmp_path / "a table")
    assert tables.delete_owner(spark, path, "none") == 0
    rows = [(f"{i}", "x", owner) for i, owner in enumerate(("a/b c", "a=b", "100%", "a/b c"))]
    tables.append_owned(spark.createDataFrame(rows, "chunk_id string, text string, owner string"), path)
    with pytest.raises(ValueError, match="already"):
        tables.append_owned(spark.createDataFrame(rows[:1], "chunk_id string, text string, owner string"), path)
    assert tables.delete_owner(spark, path, "a/b c") == 2
    assert sorted(r.owner for r in spark.read.parquet(path).collect()) == ["100%", "a=b"]
    assert tables.delete_owner(spark, path, "100%") == tables.delete_owner(spark, path, "a=b") == 1
    assert tables.row_count(spark, path) == 0
    tables.append_owned(spark.createDataFrame(rows, "chunk_id string, text string, owner string"), path)
    assert tables.row_count(spark, path) == 4
    with pytest.raises(ValueError, match="several lengths"):
        tables.append_owned(spark.createDataFrame([("p", [1.0], "o"), ("q", [1.0, 2.0], "o")], "chunk_id string, vector array<double>, owner string"), path)


def test_manifest(spark, tmp_path):
    spark.createDataFrame([("a", [1.0])], "chunk_id string, vector array<double>").write.parquet(str(tmp_path / "v"))
    tables.write_manifest(spark, str(tmp_path / "m"), "model-a", 1)
    assert tables.checked_vectors(spark, str(tmp_path / "v"), str(tmp_path / "m"), "model-a").count() == 1
    with pytest.raises(ValueError):
        tables.checked_vectors(spark, str(tmp_path / "v"), str(tmp_path / "m"), "model-b")


def test_datasets_and_files(spark, tmp_path):
    assert tables.dataset(spark, str(tmp_path / "none.json"), tables.GOLDEN).count() == 0
    (tmp_path / "adv.json").write_text('[{"id": "A1", "family": "f", "question": "q"}]')
    assert tables.dataset(spark, str(tmp_path / "adv.json"), tables.ADVERSARIAL).first().family == "f"
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "b.txt").write_bytes(b"no")
    pages = tables.parsed_pages(tables.documents_in(spark, str(tmp_path)), lambda data: data.decode().split("\f")).collect()
    assert [(r.page_number, r.text) for r in pages] == [(1, "one"), (2, "two")]


def test_embedding_is_of_unit_length(spark):
    got = spark.createDataFrame([("some words some",), ("",)], "t string").select(tables.hashed_embedding("t").alias("e")).collect()
    assert sum(x * x for x in got[0].e) == pytest.approx(1.0) and sum(map(abs, got[1].e)) == 0 and len(got[0].e) == 64


def test_html(spark):
    html = "<html><script>var x='</p>';</script><h1>Title &amp; more</h1><p>one<br>two</p><!-- no --></html>"
    got = tables.html_pages(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [x for x in got[0].text.split("\n") if x.strip()] == [" Title & more", "one", "two"] and got[1].text == ""


EVENTS = "event_id long, ts timestamp, visitor long, tokens long, key long"


def rows(n=60):
    return [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * 37 % 4000), i % 5, i * 13 % 4000, i % 3) for i in range(n)]


def drained(spark, stream, mode, name):
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()))


@pytest.mark.parametrize("build", [streams.daily_usage, lambda e: streams.sliding_usage(e, 600, 300), streams.sessions])
def test_streams_equal_batches(spark, tmp_path, build):
    batch = spark.createDataFrame(rows(), EVENTS)
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), batch.schema)
    assert drained(spark, build(stream), "complete", f"t{abs(hash(str(tmp_path)))}") == sorted(map(tuple, build(batch).collect()))


def test_admission_on_a_stream(spark, tmp_path):
    from veritome.operators import quota

    batch = spark.createDataFrame(rows(), EVENTS)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.admission_stream(streams.event_stream(spark, str(tmp_path / "in"), batch.schema).select("key", "event_id", "ts", "tokens"))
    got = {(r[1], r[2]) for r in drained(spark, stream, "append", "admissions")}
    assert got == {(r.event_id, r.decision) for r in quota.admitted(batch).collect()}


def test_ingestion_on_a_stream_adds_chunks_once(spark, tmp_path):
    pages = spark.createDataFrame([(i, 1, f"text of {i}") for i in range(5)], "doc_id long, page_number int, text string")
    identity = spark.createDataFrame([(i, f"S{i}", "v") for i in range(9)], "doc_id long, spec_id string, version string")
    chunks = lambda p: ingest.chunked(p, identity)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    pages.write.parquet(source)
    for n in (1, 2):
        stream = spark.readStream.schema(pages.schema).parquet(source)
        streams.ingest_stream(stream, chunks, out, str(tmp_path / f"state{n}")).awaitTermination()
    assert spark.read.parquet(out).count() == 5

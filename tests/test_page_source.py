import io

import pytest
from hypothesis import given
from hypothesis import strategies as st

from veritome.sources import page_source as P


@given(st.lists(st.text(alphabet="aé漢\n ", max_size=12), min_size=1, max_size=40), st.booleans(), st.integers(1, 60), st.integers(1, 30))
def test_ranges_hold_every_page_once(pages, closed, most, block):
    data = "\f".join(pages).encode() + (b"\f" if closed or not pages[-1] else b"")
    form = P.separated(block=block)
    found = list(form.ranges(io.BytesIO(data), most))
    assert [first for first, *_ in found] == [1 + sum(n for _, n, *_ in found[:i]) for i in range(len(found))]
    assert [at for _, _, at, _ in found] == [sum(size for *_, size in found[:i]) for i in range(len(found))] and sum(size for *_, size in found) == len(data)
    assert [t for r in found for t in form.read(io.BytesIO(data), r)] == pages
    assert all(size < most + max(len(p.encode()) for p in pages) + 1 for *_, size in found)


def files(folder, texts):
    for name, text in texts.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_text(text, newline="")


def test_a_large_file_is_many_tasks(spark, tmp_path):
    """Files in folders, with names that a URI would escape; other files aren't read."""
    texts = {"a b%20.txt": "\f".join(f"page {i} " + "x" * (i % 50) for i in range(3000)), "deep/c.txt": "one\f\fthree\f", "deep/d.pdf": "no"}
    files(tmp_path, texts)
    ranges = P.page_ranges(spark, str(tmp_path), "*.txt", P.separated(), 1000)
    assert ranges.where("path LIKE '%a b%'").count() > 80 and ranges.where("bytes > 1100").count() == 0
    rows = P.pages_in(spark, str(tmp_path), "*.txt", P.separated(), 1000)
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got = {(r.path.rsplit("/", 1)[1], r.page_number): r.text for r in rows.collect()}
    assert got == {("a b%20.txt", i + 1): f"page {i} " + "x" * (i % 50) for i in range(3000)} | {("c.txt", 1): "one", ("c.txt", 2): "", ("c.txt", 3): "three"}


def test_a_file_without_pages_is_an_error(spark, tmp_path):
    """By what the format says; a file of no bytes is none to Spark's readers."""
    files(tmp_path, {"a.txt": "x", "b.txt": "cover only", "c.txt": ""})
    form = P.separated()
    without_covers = P.PageFormat(lambda file, most: () if file.read(5) == b"cover" else (file.seek(0), *form.ranges(file, most))[1:], form.read)
    with pytest.raises(Exception, match="b.txt has no page"):
        P.pages_in(spark, str(tmp_path), "*.txt", without_covers)
    assert [r.text for r in P.pages_in(spark, str(tmp_path), "*.txt", form).orderBy("path").collect()] == ["x", "cover only"]

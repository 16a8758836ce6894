"""Pages of files of any size: each file is cut into ranges of pages, and the ranges, not the files, are dealt to tasks.

A `PageFormat` knows where a file's pages are and how to read some of them.  `separated` is one, of texts whose pages end in a byte; a format of one's own, say of PDF files, has a library's calls instead.
No file's content is ever a row, and the driver sees no list of files.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.sources.tables import durable

#: first page, how many pages, and where their bytes begin and how many there are
Range = tuple[int, int, int, int]


@dataclass(frozen=True)
class PageFormat:
    """ranges(file, most) are a file's pages in order, cut after so many bytes; read(file, range) are one range's texts."""

    ranges: Callable[[BinaryIO, int], Iterator[Range]]
    read: Callable[[BinaryIO, Range], list[str]]


def separated(end: bytes = b"\f", block: int = 1 << 20) -> PageFormat:
    """UTF-8 texts whose pages end in this byte, the last one's may be missing; a file is read in blocks to find them."""

    def ranges(file, most):
        first = pages = 0
        start = at = 0
        last = b""
        while data := file.read(block):
            ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == end[0]) + at + 1
            seen = 0
            while (cut := int(np.searchsorted(ends, start + most))) < len(ends):
                pages += cut + 1 - seen
                yield first + 1, pages, start, int(ends[cut]) - start
                first, pages, start, seen = first + pages, 0, int(ends[cut]), cut + 1
            pages += len(ends) - seen
            at, last = at + len(data), data[-1:]
        if at > start:
            yield first + 1, pages + (last != end), start, at - start

    def read(file, own):
        file.seek(own[2])
        return [page.decode() for page in file.read(own[3]).removesuffix(end).split(end)]

    return PageFormat(ranges, read)


def opened(path: str):
    """A file of the machine or of any store that Arrow knows, by the path as Spark names it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, inner = fs.FileSystem.from_uri(quote(path, safe=":/"))
    return store.open_input_file(inner)


def page_ranges(spark: SparkSession, folder: str, glob: str, pages: PageFormat, range_bytes: int = 8 << 20) -> DataFrame:
    """(path, first, pages, at, bytes) of a folder's files; a file in which the format finds no page is an error, one of no bytes is none to Spark's readers."""

    def cut(frames):
        import pandas as pd

        for frame in frames:
            for path in frame["path"]:
                with opened(path) as file:
                    found = pd.DataFrame(pages.ranges(file, range_bytes), columns=["first", "pages", "at", "bytes"])
                if found.empty:
                    raise ValueError(f"{path} has no page")
                yield found.assign(path=path)[["path", "first", "pages", "at", "bytes"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path")
    return files.mapInPandas(cut, "path string, first long, pages long, at long, bytes long")


def pages_in(spark: SparkSession, folder: str, glob: str, pages: PageFormat, range_bytes: int = 8 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """(path, page_number, text) of a folder's files, in tasks of about task_bytes."""
    ranges = durable(page_ranges(spark, folder, glob, pages, range_bytes))
    size = ranges.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(size.n, max(math.ceil(size.bytes / task_bytes), spark.sparkContext.defaultParallelism)))

    def read(frames):
        import pandas as pd

        for frame in frames:
            for path, *own in frame[["path", "first", "pages", "at", "bytes"]].itertuples(index=False, name=None):
                with opened(path) as file:
                    texts = pages.read(file, tuple(int(x) for x in own))
                yield pd.DataFrame({"path": path, "page_number": range(int(own[0]), int(own[0]) + len(texts)), "text": texts})

    return ranges.repartition(tasks, "path", "first").mapInPandas(read, "path string, page_number int, text string")

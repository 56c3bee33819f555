"""A Spark data source of the pages of files, which takes filters on page numbers and file names.

Files are listed once, on the driver, by name and size; none is opened there. Small files share a task; a file above the size of a split is dealt to several tasks, each of which extracts a range of its pages, so that neither a file's bytes nor its pages are ever one row. Filters that Spark pushes prune files before they are opened and pages before they are extracted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from factloom.sources.pages import finished_pages

#: Opens a file: given its stream, which can seek, returns the number of pages and a function from a page number (from 1) to the page's text.
Opener = Callable[[BinaryIO], tuple[int, Callable[[int], str]]]

SPLIT_BYTES = 64 << 20
BATCH_PAGES = 256
SCHEMA = "document_id string, source_filename string, page_number int, page_count int, text string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_ARROW = pa.schema([("document_id", pa.string()), ("source_filename", pa.string()), ("page_number", pa.int32()), ("page_count", pa.int32()), ("text", pa.string())])
_CHUNK = 1 << 20
#: Filters on a page number: what they ask of it, given the filter's value.
_PAGE_TESTS = {
    ds.EqualTo: lambda n, v: n == v,
    ds.EqualNullSafe: lambda n, v: n == v,
    ds.In: lambda n, v: n in v,
    ds.GreaterThan: lambda n, v: n > v,
    ds.GreaterThanOrEqual: lambda n, v: n >= v,
    ds.LessThan: lambda n, v: n < v,
    ds.LessThanOrEqual: lambda n, v: n <= v,
}
_NAME_TESTS = {
    ds.EqualTo: lambda n, v: n == v,
    ds.EqualNullSafe: lambda n, v: n == v,
    ds.In: lambda n, v: n in v,
    ds.StringStartsWith: lambda n, v: n.startswith(v),
    ds.StringEndsWith: lambda n, v: n.endswith(v),
    ds.StringContains: lambda n, v: v in n,
}
_TESTS = {("page_number",): _PAGE_TESTS, ("source_filename",): _NAME_TESTS}


@dataclass
class Share(ds.InputPartition):
    """What one task reads: (path, which share, of how many shares) of each file."""

    files: list[tuple[str, int, int]]


def _value(f: ds.Filter):
    """Missing values in a comparison match no row."""
    return {v for v in f.value if v is not None} if isinstance(f, ds.In) else f.value


def _matches(filters: list[ds.Filter], column: str, x) -> bool:
    return all(_TESTS[f.attribute][type(f)](x, _value(f)) for f in filters if f.attribute == (column,) and not isinstance(f, ds.IsNotNull))


def shares(files: list[tuple[str, int]], split: int) -> list[Share]:
    """Files (path, bytes) dealt to tasks of about split bytes each, in the order of their paths."""
    out: list[Share] = []
    small: list[tuple[str, int, int]] = []
    size = 0
    for path, n in sorted(files):
        of = max(1, math.ceil(n / split))
        if of > 1:
            out.extend(Share([(path, i, of)]) for i in range(of))
            continue
        if small and size + n > split:
            out.append(Share(small))
            small, size = [], 0
        small.append((path, 0, 1))
        # An empty file costs an opening all the same.
        size += max(n, split // 1024)
    return [*out, *([Share(small)] if small else [])]


class _PageReader(ds.DataSourceReader):
    def __init__(self, options, opener: Opener):
        self.opener = opener
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            tests = _TESTS.get(getattr(f, "attribute", None))
            if tests and (isinstance(f, ds.IsNotNull) or type(f) in tests) and getattr(f, "value", "") is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Share]:
        files, at = fs.FileSystem.from_uri(self.folder)
        found = files.get_file_info(fs.FileSelector(at))
        kept = [f for f in found if f.type == fs.FileType.File and fnmatchcase(f.base_name, self.pattern) and not f.base_name.startswith((".", "_")) and _matches(self.filters, "source_filename", f.base_name)]
        # Spark wants one partition at least.
        return shares([(f.path, f.size) for f in kept], self.split) or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.folder)
        rows: list[tuple] = []
        for path, share, of in partition.files:
            with files.open_input_file(path) as stream:
                count, text = self.opener(stream)
                # The range's ends are rounded alike for all shares, so that each page lies in exactly one.
                wanted = [n for n in range(count * share // of + 1, count * (share + 1) // of + 1) if _matches(self.filters, "page_number", n)]
                if not wanted:
                    continue
                id_ = _id(stream)
                for n in wanted:
                    rows.append((id_, path.rsplit("/", 1)[-1], n, count, text(n)))
                    if len(rows) >= BATCH_PAGES:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _id(stream: BinaryIO) -> str:
    """The document's id (see pages.document_id), read in pieces."""
    digest = hashlib.sha256()
    stream.seek(0)
    while piece := stream.read(_CHUNK):
        digest.update(piece)
    return digest.hexdigest()[:16]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def text_pages(stream: BinaryIO) -> tuple[int, Callable[[int], str]]:
    """Form feeds part the pages of a text file. Only their places are kept; a page is read when it is asked for."""
    ends, at = [], 0
    while piece := stream.read(_CHUNK):
        i = piece.find(b"\f")
        while i >= 0:
            ends.append(at + i)
            i = piece.find(b"\f", i + 1)
        at += len(piece)
    ends.append(at)

    def text(n: int) -> str:
        start = ends[n - 2] + 1 if n > 1 else 0
        stream.seek(start)
        return stream.read(ends[n - 1] - start).decode("utf-8", "replace")

    return len(ends), text


def pdf_pages(stream: BinaryIO) -> tuple[int, Callable[[int], str]]:
    """Pages of a PDF file, where a PDF library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the pypdf library; give scan_files another opener, or use text pages") from e
    pages = PdfReader(stream).pages
    return len(pages), lambda n: pages[n - 1].extract_text() or ""


def page_source(opener: Opener, name: str) -> type[ds.DataSource]:
    """The data source of files that opener opens, to be registered under name."""

    class PageSource(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> ds.DataSourceReader:
            return _PageReader(self.options, opener)

    return PageSource


def scan_files(spark: SparkSession, folder: str, opener: Opener = text_pages, pattern: str = "*.pdf", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pages of the files in a folder, finished as read_files does, and each file's page_count, whatever pages are filtered out. Filters on page_number (comparisons, lists) and source_filename (also beginnings, ends and parts) reach the source.

    A page without text is a row with an empty text; an empty file has one such page. Hidden files are left out. A folder that isn't there raises FileNotFoundError; a folder without such files has no pages. Errors of the opener fail the task."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise FileNotFoundError(folder)
    spark.conf.set(PUSHDOWN, "true")
    source = page_source(opener, f"factloom_{getattr(opener, '__name__', 'pages').strip('<>')}_{abs(hash(opener)):x}")
    spark.dataSource.register(source)
    uri = system.makeQualified(path).toString()
    return finished_pages(spark.read.format(source.name()).option("pattern", pattern).option("splitBytes", split_bytes).load(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri))

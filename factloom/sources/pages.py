"""Pages of documents: from files through a reader, from tables, and their warnings."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import or_empty, strip

LOW_TEXT = 50


def document_id(content: Column) -> Column:
    """The first 16 hexadecimal digits of the content's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, source_filename, length of the files in a folder, by name; their content is not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("source_filename"), "length").orderBy("source_filename")


def select_pages(pages: DataFrame, wanted: DataFrame | dict[str, list[int]] | list[int] | None) -> DataFrame:
    """Only the wanted pages: a list for all documents, or lists by file name; documents without a list keep all pages."""
    if not wanted:
        return pages
    if isinstance(wanted, list):
        return pages.filter(F.col("page_number").isin(wanted))
    if isinstance(wanted, dict):
        wanted = pages.sparkSession.createDataFrame(list(wanted.items()), "source_filename string, wanted array<int>")
    kept = pages.join(wanted, "source_filename", "left")
    return kept.filter(F.col("wanted").isNull() | (F.size("wanted") == 0) | F.array_contains("wanted", F.col("page_number"))).drop("wanted")


def finished_pages(pages: DataFrame, low: int = LOW_TEXT) -> DataFrame:
    """Strips texts and adds char_count and warnings. pages: document_id, source_filename, page_number, text."""
    p = pages.withColumn("text", strip(or_empty(F.col("text")))).withColumn("char_count", F.length("text").cast("int"))
    # Fixed value: the warning's wording.
    warning = F.format_string("Page %d produced minimal text (%d chars). May be scanned, graphical, or blank.", F.col("page_number"), F.col("char_count"))
    return p.withColumn("warnings", F.when(F.col("char_count") < low, F.array(warning)).otherwise(F.array().cast("array<string>")))


def documents_of(pages: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """Rows of the documents table from finished pages. A document's page count is what page_counts (document_id, page_count) says; else what its pages bring along as page_count, which readers of files fill, wanted or not; else the number of its pages."""
    told = F.transform(F.array_sort(F.collect_list(F.when(F.size("warnings") > 0, F.struct("page_number", "warnings")))), lambda x: x["warnings"])
    own = F.max("page_count") if "page_count" in pages.columns else F.lit(None)
    many = F.count("*").cast("int")
    docs = pages.groupBy(F.col("document_id").alias("id")).agg(F.min("source_filename").alias("filename"), many.alias("processed_pages"), F.coalesce(own.cast("int"), many).alias("_own"), F.flatten(told).alias("warnings"))
    counts = docs.select("id", F.col("_own").alias("page_count")) if page_counts is None else page_counts.select(F.col("document_id").alias("id"), F.col("page_count").cast("int").alias("page_count"))
    zero = F.lit(0).cast("int")
    return docs.join(counts, "id", "left").select("id", "filename", "page_count", "processed_pages", zero.alias("extracted_facts_count"), zero.alias("grounded_facts_count"), F.lit("extracted").alias("status"), "warnings", F.current_timestamp().alias("created_at"))


Reader = Callable[..., list[str] | tuple[int, list[tuple[int, str]]]]


def read_files(spark: SparkSession, folder: str, reader: Reader, pattern: str = "*.pdf", wanted: dict[str, list[int]] | list[int] | None = None) -> DataFrame:
    """Pages of the files in a folder. The reader runs on the executors, once a file. It is given a file's bytes and returns the text of each page; or, if it takes a second parameter, also the wanted page numbers (or None for all), and returns the number of pages and (page number, text) of the wanted ones, so that the others are never extracted.

    wanted: page numbers for all files, or by file name; files without any keep all pages. A folder that isn't there raises FileNotFoundError; a folder without such files has no pages."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(folder)
    prunes = len(inspect.signature(reader).parameters) > 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    files = files.select(document_id(F.col("content")).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("source_filename"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                asked = wanted.get(name) if isinstance(wanted, dict) else wanted
                asked = set(asked) if asked else None
                if prunes:
                    count, pages = reader(content, asked)
                else:
                    texts = reader(content)
                    count, pages = len(texts), [(k, t) for k, t in enumerate(texts, 1) if asked is None or k in asked]
                n = len(pages)
                yield pa.RecordBatch.from_pydict({"document_id": [i] * n, "source_filename": [name] * n, "page_number": pa.array([p[0] for p in pages], pa.int32()), "page_count": pa.array([count] * n, pa.int32()), "text": pa.array([p[1] for p in pages], pa.string())})

    return finished_pages(files.mapInArrow(run, "document_id string, source_filename string, page_number int, page_count int, text string"))


def pdf_reader() -> Reader:
    """A reader of PDF files, where a PDF library is installed. Only wanted pages are extracted."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the pypdf library; give read_files another reader, or use text pages") from e
    import io

    def read(content: bytes, wanted: set[int] | None) -> tuple[int, list[tuple[int, str]]]:
        pages = PdfReader(io.BytesIO(content)).pages
        return len(pages), [(i, pages[i - 1].extract_text() or "") for i in range(1, len(pages) + 1) if wanted is None or i in wanted]

    return read


def plain_text_reader(content: bytes) -> list[str]:
    """Form feeds part the pages of a text file."""
    return content.decode("utf-8", "replace").split("\f")


def pages_from_text(docs: DataFrame, id_: str = "doc_id", text: str = "text", filename: Column | None = None) -> DataFrame:
    """Each line of a document's text as one page."""
    name = F.concat(F.lit("doc-"), F.col(id_).cast("string")) if filename is None else filename
    lines = docs.select(F.col(id_).cast("string").alias("document_id"), name.alias("source_filename"), F.posexplode(F.split(or_empty(F.col(text)), "\n")).alias("_i", "text"))
    return finished_pages(lines.select("document_id", "source_filename", (F.col("_i") + 1).cast("int").alias("page_number"), "text"))

"""A store as one JSON document: summary, one showcase of each kind, first facts, all facts, all relationships; and back.

Every fact and every relationship is a line of its own. Spark writes the lines as sorted part files, whose concatenation is the document. They are packed until one task copies them into one file in small pieces: the document is a single file by its nature, but nowhere in memory. Read again, it is split by lines like any text file, so no task has to hold it.

A document whose name ends with .gz stays packed: the part files are its members, as gzip allows, and a small table beside it tells where each begins, so that they are read in parallel. Without that table any reader of gzip reads it, in one task.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.schemas import RELATIONSHIP_TYPES, TABLES
from factloom.operators.shared import shared_dir
from factloom.operators.store import FactStore, save_with_documents
from factloom.operators.views import summary

SAMPLE = 15
ORDER = ("source_filename", "page_number", "id")
_NULLS = {"ignoreNullFields": "false"}
_PIECE = 1 << 20
MEMBERS = ".members"


def _value(x: str = "") -> Column:
    """A fact's value, as it is one field of the document: a number, a text or null."""
    return F.coalesce(F.col(f"{x}norm_num").cast("variant"), F.col(f"{x}norm_text").cast("variant"))


def _fact(x: str = "") -> Column:
    names = [n for n in TABLES["facts"].fieldNames() if n != "norm_text"]
    return F.struct(*(_value(x).alias("normalized_value") if n == "norm_num" else F.col(f"{x}{n}").alias(n) for n in names))


def _edge() -> Column:
    names = [n for n in TABLES["relationships"].fieldNames() if n not in ("fact_a", "fact_b")]
    return F.struct(*names, F.when(F.col("fact_a").isNotNull(), _fact("fact_a.")).alias("fact_a"), F.when(F.col("fact_b").isNotNull(), _fact("fact_b.")).alias("fact_b"))


def _json(c: Column) -> Column:
    return F.to_json(c, _NULLS)


def _lines(rows: DataFrame, item: Column, order: tuple[str, ...]) -> DataFrame:
    """One line an item, sorted; all but the first begin with a comma."""
    key = F.struct(*order)
    first = rows.agg(F.min(key).alias("first")).first()["first"]
    is_first = F.lit(first is not None)
    for c in order if first is not None else ():
        is_first = is_first & F.col(c).eqNullSafe(F.lit(first[c]).cast(rows.schema[c].dataType))
    return rows.orderBy(*order).select(F.concat(F.when(is_first, F.lit("")).otherwise(F.lit(",")), _json(item)).alias("line"))


def _case(kind: str) -> Column:
    """The pair of a kind that is surest, ties by id."""
    side = lambda f: F.struct(F.col(f"{f}.source_filename").alias("file"), F.col(f"{f}.page_number").alias("page"), F.col(f"{f}.raw_value").alias("raw_value"), _value(f"{f}.").alias("normalized_value"), F.col(f"{f}.scope").alias("scope"), F.col(f"{f}.evidence_quote").alias("evidence"))
    shown = F.struct(F.col("fact_a.predicate").alias("metric"), side("fact_a").alias("doc_a"), side("fact_b").alias("doc_b"), F.col("relationship_type").alias("classification"), "confidence", F.col("short_explanation").alias("reasoning"))
    rank = F.when(F.col("relationship_type") == kind, F.struct((-F.col("confidence")).alias("c"), F.col("id")))
    return F.min_by(_json(shown), rank).alias(kind.lower())


def _head(store: FactStore, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """One line: all before the list of facts. Its parts have one row each."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    counts = one(summary(facts, edges).select(_json(F.struct("*")).alias("summary")))
    cases = one(edges.agg(*(_case(k) for k in RELATIONSHIP_TYPES)))
    events = store.read("processing_events")
    failure = F.struct("failure_type", "document_filename", "page_number", "what_happened", "why_it_happened", "how_handled", "future_improvement")
    failed = one(events.agg(F.min_by(_json(failure), F.struct("document_filename", "page_number", "id")).alias("failure")))
    first = facts.orderBy(*ORDER).limit(SAMPLE).select(F.struct(*ORDER, _json(_fact()).alias("line")).alias("f"))
    sample = one(first.agg(F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["line"]), ",").alias("sample")))
    shown = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.col(k), F.lit("null"))) for k in (*(t.lower() for t in RELATIONSHIP_TYPES), "failure")]
    line = F.concat(F.lit('{"summary":'), F.col("summary"), F.lit(',"showcase":{'), F.concat_ws(",", *shown), F.lit('},"sample_extracted_facts":['), F.col("sample"), F.lit('],"all_facts":['))
    return counts.join(cases, "_one").join(failed, "_one").join(sample, "_one").select(line.alias("line"))


def export_document(store: FactStore, path: str) -> None:
    """Writes the store as the JSON file path, packed if its name ends with .gz, in place of what is there. Facts are in the order of file, page and id, relationships in that of their ids. A showcase without a pair or event is null; an empty store has empty lists."""
    spark = store.spark
    parts = f"{shared_dir(spark)}/document-{uuid.uuid4().hex}"
    facts, edges = store.read("facts"), store.read("relationships")
    text = lambda s: spark.createDataFrame([(s,)], "line string").coalesce(1)
    sections = (_head(store, facts, edges), _lines(facts, _fact(), ORDER), text('],"relationships":['), _lines(edges, _edge(), ("id",)), text("]}"))
    for i, lines in enumerate(sections):
        lines.write.option("compression", "gzip").text(f"{parts}/{i}")
    qualified = lambda p: store._fs(p)[0].makeQualified(store._fs(p)[1]).toString()
    source, target = qualified(parts), qualified(path)
    n = len(sections)
    packed = path.endswith(".gz")
    members = spark.range(1).coalesce(1).mapInArrow(lambda batches: _joined(batches, source, target, n, packed), "at long, bytes long")
    if packed:
        members.write.mode("overwrite").parquet(f"{path}{MEMBERS}")
    else:
        members.collect()
    store.drop(parts)


def _joined(batches: Iterator[pa.RecordBatch], source: str, target: str, sections: int, packed: bool) -> Iterator[pa.RecordBatch]:
    """Copies the part files of all sections into one file, which gets its name when it is whole; run again, it starts anew. Returns where each begins there and how long it is; unpacked, one row for all."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(source)
    for b in batches:
        if not b.num_rows:
            continue
        out, to = fs.FileSystem.from_uri(target)
        folder, name = to.rsplit("/", 1)
        out.create_dir(folder, recursive=True)
        part, size, starts = f"{folder}/.{name}-{uuid.uuid4().hex}", 0, [0]
        with out.open_output_stream(part) as sink:
            for i in range(sections):
                for f in sorted(files.get_file_info(fs.FileSelector(f"{at}/{i}")), key=lambda f: f.base_name):
                    if f.base_name.startswith("part-"):
                        # Unpacked as its name says, if the document is to be plain.
                        with files.open_input_stream(f.path, compression=None if packed else "detect") as stream:
                            while piece := stream.read(_PIECE):
                                sink.write(piece)
                                size += len(piece)
                        if packed and size > starts[-1]:
                            starts.append(size)
        out.move(part, to)
        ends = starts[1:] if packed else [size]
        yield pa.RecordBatch.from_pydict({"at": pa.array(starts[: len(ends)], pa.int64()), "bytes": pa.array([e - s for s, e in zip(starts, ends)], pa.int64())})


def _unpacked(batches: Iterator[pa.RecordBatch], source: str) -> Iterator[pa.RecordBatch]:
    """Lines of the members that begin at these places of a packed document, piece by piece."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(source)
    lines = lambda found: pa.RecordBatch.from_pydict({"value": pa.array(found, pa.binary()).cast(pa.string())})
    for b in batches:
        for row in b.to_pylist():
            with files.open_input_file(path) as stream:
                stream.seek(row["at"])
                left, rest, gzip = row["bytes"], b"", zlib.decompressobj(wbits=31)
                while left and (piece := stream.read(min(_PIECE >> 3, left))):
                    left -= len(piece)
                    *found, rest = (rest + gzip.decompress(piece)).split(b"\n")
                    if found:
                        yield lines(found)
                if left or not gzip.eof:
                    raise OSError(f"{source} ends within the member at {row['at']}")
                if rest:
                    yield lines([rest])


def _text(store: FactStore, path: str) -> DataFrame:
    """The document's lines; a packed one's by members, if the table of these is there and fits the file."""
    spark, at = store.spark, f"{path}{MEMBERS}"
    fs, place = store._fs(path)
    if path.endswith(".gz") and "_SUCCESS" in store._names(at):
        members = spark.read.schema("at long, bytes long").parquet(at)
        said = members.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
        if said["bytes"] == store._size(path):
            source = fs.makeQualified(place).toString()
            return members.repartition(said["n"]).mapInArrow(lambda batches: _unpacked(batches, source), "value string")
    return spark.read.text(path)


def seed_document(store: FactStore, path: str) -> None:
    """Fills a store from a document that export_document wrote: its lines are read in parallel, lists and all. (seed_from_document reads any such document, whole.)"""
    line = F.regexp_replace("value", "^,", "")
    lines = _text(store, path).select(line.alias("line")).filter(F.col("line").startswith('{"id":'))
    # The second field tells what a line is, so it need not be parsed for that.
    is_edge = F.col("line").rlike(r'^\{"id":(?:null|"(?:[^"\\]++|\\.)*+"),"fact_a_id":')
    given = ",".join(f"{f.name}:{f.dataType.simpleString()}" if f.name != "norm_num" else "normalized_value:variant" for f in TABLES["facts"].fields if f.name != "norm_text")
    plain = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in TABLES["relationships"].fields if f.name not in ("fact_a", "fact_b"))

    def fields(x: str) -> list[Column]:
        # A text that looks like a number is a text still: the value's own type decides.
        kind = F.expr(f"schema_of_variant({x}.normalized_value)")
        value = lambda t, is_text: F.when((kind == "STRING") == is_text, F.expr(f"try_variant_get({x}.normalized_value, '$', '{t}')"))
        special = {"norm_num": value("double", False), "norm_text": value("string", True)}
        return [(special[n] if n in special else F.col(f"{x}.{n}")).alias(n) for n in TABLES["facts"].fieldNames()]

    facts = lines.filter(~is_edge).select(F.from_json("line", f"struct<{given}>").alias("f")).select(*fields("f"))
    edges = lines.filter(is_edge).select(F.from_json("line", f"struct<{plain},fact_a:struct<{given}>,fact_b:struct<{given}>>").alias("r"))
    rows = [F.col(f"r.{n}").alias(n) for n in TABLES["relationships"].fieldNames() if n not in ("fact_a", "fact_b")]
    side = lambda f: F.when(F.col(f"r.{f}").isNotNull(), F.struct(*fields(f"r.{f}"))).alias(f)
    save_with_documents(store, facts)
    store.save("relationships", edges.select(*rows, side("fact_a"), side("fact_b")))

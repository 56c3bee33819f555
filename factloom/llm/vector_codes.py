"""Vector code compression: vectors as bytes, one for each of their parts, by integer codebooks.

Each component x is the integer floor(256 * x). A vector is cut into equal consecutive parts, and each part position has a codebook of up to 64 entries, which begins as that part of the vectors of smallest ids. A round assigns every part to its nearest entry and puts the floor of the mean in place of each entry that has parts.

Codebooks are broadcast (64 * dimension integers). Tasks take Arrow batches, get all squared distances of a part position at once from |x|^2 - 2xc + |c|^2 with int64 matrix products, which are exact, and add up their own sums and counts; one row for each entry's component then goes through a grouped shuffle. Only the merged codebook reaches the driver.

Cases with a defined result:
- a vector that is null, holds null or non-finite components, or whose length is not that of most vectors (ties: the shorter) or no positive multiple of the number of parts has no row;
- of a repeated id the vector that is least in order is a codebook's start; all its rows are encoded; a null id is the greatest;
- fewer than 64 ids make smaller codebooks; an empty table gives no rows;
- equal entries: the lower index is nearest; labels that are null are one label;
- integers end at +-2^62, and sums of errors at the greatest long; distances that int64 can't hold are computed with Python's integers;
- other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
END = 1 << 62
LONG_MAX = (1 << 63) - 1
#: Labels with at least this share of the rows are at most as many as its inverse, so their sums can be broadcast.
HEAVY = 1 / 1000


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite."""
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a batch as a matrix of integers."""
    x = np.floor(np.asarray(column.flatten(), dtype=np.float64) * SCALE).reshape(-1, dim)
    return np.clip(x, -float(END), float(END)).astype(np.int64)


def nearest(x: np.ndarray, books: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for each part position and vector. x: parts x vectors x width, books: parts x entries x width."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    if 4 * most * most * x.shape[0] * x.shape[2] > LONG_MAX:
        x, books = x.astype(object), books.astype(object)
    at, best = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], x.dtype)
    for p, book in enumerate(books):
        crossed, own = np.ascontiguousarray(-2 * book.T), (book * book).sum(axis=1)
        for i in range(0, x.shape[1], block):
            d = np.dot(x[p, i : i + block], crossed)
            d += own
            first = np.argmin(d, axis=1)
            at[p, i : i + block], best[p, i : i + block] = first, d[np.arange(len(first)), first]
    return at, best + (x * x).sum(axis=2)


def _by_part(x: np.ndarray, parts: int) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(len(x), parts, x.shape[1] // parts).transpose(1, 0, 2))


def _sums(shared: Broadcast, dim: int, parts: int):
    """A task's sums and counts of the parts that are nearest to each entry, one row for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total = np.zeros(books.shape, dtype=object)
        count = np.zeros(books.shape[:2], dtype=np.int64)
        for b in batches:
            x = _by_part(integers(b.column(0), dim), parts)
            at, _ = nearest(x, books)
            wide = int(np.abs(x).max(initial=0)) * max(1, x.shape[1]) > LONG_MAX
            for p in range(parts):
                own = np.zeros(books.shape[1:], dtype=object if wide else np.int64)
                np.add.at(own, at[p], x[p].astype(object) if wide else x[p])
                total[p] += own
                count[p] += np.bincount(at[p], minlength=books.shape[1])
        p, e = np.nonzero(count)
        width = books.shape[2]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(p, width), pa.int32()),
                pa.array(np.repeat(e, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(p)), pa.int32()),
                pa.array([Decimal(int(v)) for v in total[p, e].ravel()], pa.decimal128(38, 0)),
                pa.array(np.repeat(count[p, e], width), pa.int64()),
            ],
            ["part", "entry", "at", "s", "n"],
        )

    return run


def _codes(shared: Broadcast, dim: int, parts: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in batches:
            at, d = nearest(_by_part(integers(b.column(2), dim), parts), books)
            codes = [c.tobytes().hex() for c in at.T.astype(np.uint8)]
            errors = [min(int(e), LONG_MAX) for e in d.sum(axis=0)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names)

    return run


def _first_books(vectors: DataFrame, dim: int, parts: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest ids, in their order. At most ENTRIES vectors reach the driver."""
    order = F.col("vec_id").asc_nulls_last()
    ids = vectors.select("vec_id").distinct().orderBy(order).limit(ENTRIES)
    chosen = vectors.join(F.broadcast(ids.withColumnRenamed("vec_id", "_id")), F.col("vec_id").eqNullSafe(F.col("_id"))).drop("_id")
    rows = chosen.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(order).collect()
    x = np.floor(np.array([r["v"] for r in rows], dtype=np.float64).reshape(-1, dim) * SCALE)
    return _by_part(np.clip(x, -float(END), float(END)).astype(np.int64), parts)


def train(vectors: DataFrame, dim: int, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after some rounds. vectors: vec_id and v, an array of dim doubles without nulls."""
    books = _first_books(vectors, dim, parts)
    sc = vectors.sparkSession.sparkContext
    for _ in range(rounds if books.shape[1] else 0):
        shared = sc.broadcast(books)
        own = vectors.select("v").mapInArrow(_sums(shared, dim, parts), "part int, entry int, at int, s decimal(38,0), n long")
        merged = own.groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        books = books.copy()
        for r in merged:
            books[r["part"], r["entry"], r["at"]] = int(r["s"]) // r["n"]
        shared.unpersist()
    return books


def digest_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable vector.

    Errors are added up by label; the sums of labels with many rows are broadcast, which are few, and all others joined by label."""
    found = rows.filter(usable(vector)).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    found = found.filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    size = found.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = size["dim"] if size else parts
    vectors = found.filter(F.size("v") == dim)
    books = train(vectors, dim, parts, rounds)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType for f in found.schema.fields}
    schema = T.StructType([T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = cut(vectors.mapInArrow(_codes(shared, dim, parts, schema.fieldNames()), schema))
    sums = cut(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")))
    of_label = sums.select(F.col("label").alias("_label"), F.least("s", F.lit(Decimal(LONG_MAX))).cast("long").alias("label_error"), "n")
    least = F.lit((size["count"] if size else 0) * HEAVY)
    heavy, light = F.broadcast(of_label.filter(F.col("n") >= least)), of_label.filter(F.col("n") < least)
    same = F.col("label").eqNullSafe(F.col("_label"))
    told = coded.join(heavy, same).unionByName(coded.join(heavy, same, "left_anti").join(light, same))
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))

import hashlib
from collections import Counter

import pytest
from helpers import DATA
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.vector_codes import compress, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"
LONG_MAX = (1 << 63) - 1


def plain(rows, parts=16, rounds=2, entries=64):
    """(id, code, error, label_error) of each row and the codebooks, with Python's integers and loops only."""
    end, inf = 1 << 62, float("inf")
    good = [(i, v, y) for i, v, y in rows if v and len(v) % parts == 0 and all(x is not None and x == x and abs(x) < inf for x in v)]
    sizes = Counter(len(v) for _, v, _ in good)
    dim = min(sizes, key=lambda d: (-sizes[d], d)) if sizes else parts
    width = dim // parts
    good = [(i, v, y) for i, v, y in good if len(v) == dim]

    def whole(v):
        scaled = [x * 256 for x in v]
        return [max(-end, min(end, int(x // 1))) for x in scaled]

    first = {}
    for i, v, _ in good:
        first[i] = min(first.get(i, v), v)
    order = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    books = [[cut(whole(first[i]))[p] for i in order] for p in range(parts)]
    vectors = [cut(whole(v)) for _, v, _ in good]

    def choose(part, book):
        d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in vectors:
                members.setdefault(choose(v[p], books[p])[0], []).append(v[p])
            for e, own in members.items():
                books[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
    coded = [[choose(v[p], books[p]) for p in range(parts)] for v in vectors]
    errors = [min(sum(d for _, d in c), LONG_MAX) for c in coded]
    of_label = Counter()
    for (_, _, y), e in zip(good, errors):
        of_label[y] += e
    text = ",".join(str(x) for book in books for e in book for x in e)
    out = [(i, "".join(f"{e:02x}" for e, _ in c), err, min(of_label[y], LONG_MAX)) for (i, _, y), c, err in zip(good, coded, errors)]
    return sorted(out, key=str), hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, schema=SCHEMA, **more):
    got = compress(spark.createDataFrame(rows, schema), **more).collect()
    want, digest = plain([r[:3] for r in rows], **more)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} <= {digest}
    return got


def test_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    assert len(check(spark, [tuple(r) for r in rows])) == len(rows)


def test_odd_rows(spark):
    import random

    r = random.Random(5)
    vector = lambda n=32: [r.uniform(-2, 2) for _ in range(n)]
    f32 = lambda v: [float(__import__("numpy").float32(x)) for x in v]
    rows = [(i, f32(vector()), r.choice([0, 1, None])) for i in range(90)]
    rows += [rows[3], rows[3], (4, f32(vector()), 2), (None, f32(vector()), None), (200, None, 1), (201, [], 1), (202, [None] + f32(vector(31)), 1)]
    rows += [(203, [float("nan")] + f32(vector(31)), 1), (204, [float("inf")] + f32(vector(31)), 1), (-1, f32(vector(16)), 1), (-2, f32(vector(33)), 1), (-3, [0.0] * 32, 7)]
    got = check(spark, rows)
    assert {x["vec_id"] for x in got}.isdisjoint({200, 201, 202, 203, 204, -1, -2})


def test_ties_few_rows_and_unused_entries(spark):
    same = [0.5] * 16
    check(spark, [(i, same, 1) for i in range(70)])  # every entry equal: index 0, the others unused
    check(spark, [(2, [1.0] * 16, 1), (1, [-1.0] * 16, None)])
    check(spark, [(i, [float(i % 3)] * 16, i % 2) for i in range(10)], rounds=0)


def test_great_components(spark):
    rows = [(i, [(-1) ** j * 10.0 ** (i % 30) for j in range(16)], i % 2) for i in range(70)]
    check(spark, rows, "vec_id long, embedding array<double>, label int")


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert compress(df).count() == 0
    rows = [(i, [float(i)] * 16, "x", 1, 2, 3) for i in range(5)]
    got = compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, v int, code int, error int"))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 5


def test_many_labels(spark):
    """Labels too rare to be broadcast are joined."""
    rows = [(i, [float(i % 7), 1.0] * 8, i // 2) for i in range(2400)]
    got = compress(spark.createDataFrame(rows, SCHEMA))
    per = got.withColumn("label", F.floor(F.col("vec_id") / 2)).groupBy("label").agg(F.sum("error").alias("s"), F.min("label_error").alias("a"), F.max("label_error").alias("b"), F.count("*").alias("n"))
    assert per.count() == 1200 and per.filter("s <> a or a <> b or n <> 2").count() == 0


@pytest.mark.parametrize("size", [1, 5000])
def test_nearest_blocks(size):
    import numpy as np

    r = np.random.default_rng(3)
    x, b = r.integers(-9, 9, (2, size, 3)), r.integers(-9, 9, (2, 8, 3))
    at, d = nearest(x, b)
    every = ((x[:, :, None, :] - b[:, None, :, :]) ** 2).sum(axis=3)
    assert (at == every.argmin(axis=2)).all() and (d == every.min(axis=2)).all()


def test_schema(spark):
    assert compress(spark.createDataFrame([], SCHEMA)).schema["error"].dataType == T.LongType()

"""Shards by a k-d tree over document metadata, from DataFrame functions only.

A point is a distinct text with all its copies: its weight is their bytes, so copies are never parted. Its dimensions are its first copy's language, source and id and its length, each taken as a 62-bit integer that keeps order; of strings these are the bytes after what all values begin with.
A point heavier than a leaf may be is a leaf of its own. The others form the root, which is owed as many leaves as its bytes fill; a node that is owed more than one is split along the dimension in which it is widest, relative to the whole table, at the weighted quantile that parts its leaves into two halves (the median, where their number is even). Splitting ends where a node is owed one leaf, which is when it has reached the target bytes.
The quantile is found by adding up bytes in equal ranges of the dimension's values, and again within the range that holds it, until that range is one value; ties on a value are ordered by the text's hash in the same way. What reaches the driver is a number of ranges for each node, and cuts are rules in the plan, so leaves should be some thousands at most.

Edge cases: a null text weighs 1 byte; null metadata sorts first; a table without rows has no shards; with fewer points than leaves some shards are empty; repeated rows get different slots; extra columns are ignored.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

#: Ranges that a span of values is counted in at a time, as a power of two.
RANGE_BITS = 10
SPAN_BITS = 62
#: Rows that a chunk of a shard holds on average while slots are dealt, and copies of a row that are dealt together at most.
CHUNK_ROWS = 20_000
DIMS = ("d0", "d1", "d2", "d3")


def _prefixes(docs: DataFrame, names: list[str]) -> list[int]:
    """How many bytes all values of these columns begin with that are the same."""
    filled = {c: F.when(F.col(c) != "", F.col(c)) for c in names}
    r = docs.agg(*(f(F.encode(x, "UTF-8")).alias(f"{a}_{c}") for c, x in filled.items() for a, f in (("lo", F.min), ("hi", F.max)))).first()
    return [len(os.path.commonprefix([bytes(r[f"lo_{c}"] or b""), bytes(r[f"hi_{c}"] or b"")])) for c in names]


def _rank_of_text(c: Column, skip: int) -> Column:
    """The seven bytes of a string after those skipped, as an integer that keeps byte order."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), skip + 1, 7)), 14, "0"), 16, 10).cast("long")


def points(docs: DataFrame) -> DataFrame:
    """One row per distinct text: key (hash), weight, n, and the dimensions d0, d1, ..."""
    source, lang = _prefixes(docs, ["source", "lang"])
    d = docs.select("doc_id", "lang", "source", _size(F.col("text")).alias("size"), *_key())
    first = F.min(F.struct("doc_id", "lang", "source")).alias("f")
    g = d.groupBy("k1", "k2").agg(F.sum("size").alias("weight"), F.count("*").alias("n"), F.max("size").alias("length"), first)
    dims = [_rank_of_text(F.col("f.source"), source), _rank_of_text(F.col("f.lang"), lang), F.col("length"), F.coalesce(F.greatest(F.col("f.doc_id"), F.lit(0)), F.lit(0)).cast("long")]
    return g.select("k1", "k2", "weight", "n", *(x.alias(c) for c, x in zip(DIMS, dims, strict=True)), F.col("k1").bitwiseAND((1 << SPAN_BITS) - 1).alias("tie"))


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _key() -> tuple[Column, Column]:
    """128 bits of the text's MD5; null and empty texts are one group."""
    m = F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    half = lambda a: F.conv(F.substring(m, a, 15), 16, 10).cast("long")
    return half(1).alias("k1"), half(16).alias("k2")


def _median(pts: DataFrame, nodes: dict[int, dict]) -> None:
    """Sets the weighted quantile of each node that its goal asks for as two bounds: rows below (value, tie) in order go left. nodes: number → {"dim", "goal"}."""
    state = {k: {"lo": [0, 0], "bits": SPAN_BITS, "at": 0, "below": 0} for k in nodes}
    #: at 0 the dimension's value is searched for, at 1 the tie among rows with that value.
    while state:
        value = lambda k, s: F.col(f"d{nodes[k]['dim']}") if s["at"] == 0 else F.col("tie")
        tests = None
        for k, s in state.items():
            shift = max(0, s["bits"] - RANGE_BITS)
            part = F.call_function("shiftright", value(k, s) - F.lit(s["lo"][s["at"]]), F.lit(shift))
            inside = (F.col("node") == k) & (value(k, s) >= s["lo"][s["at"]]) & (F.call_function("shiftright", value(k, s) - F.lit(s["lo"][s["at"]]), F.lit(s["bits"])) == 0)
            if s["at"] == 1:
                inside &= F.col(f"d{nodes[k]['dim']}") == s["lo"][0]
            tests = F.when(inside, part) if tests is None else tests.when(inside, part)
        found: dict[int, dict[int, int]] = {}
        for node, part, weight in pts.withColumn("part", tests).filter("part is not null").groupBy("node", "part").agg(F.sum("weight")).collect():
            found.setdefault(node, {})[part] = weight
        for k in list(state):
            s = state[k]
            shift = max(0, s["bits"] - RANGE_BITS)
            for part in sorted(found.get(k, {})):
                if s["below"] + found[k][part] > nodes[k]["goal"] or part == max(found[k]):
                    break
                s["below"] += found[k][part]
            s["lo"][s["at"]] += part << shift
            s["bits"] = shift
            if shift == 0 and s["at"] == 0:
                s |= {"at": 1, "bits": SPAN_BITS}
            elif shift == 0:
                # The median's own row goes to the side that leaves less over.
                weight = found[k][part]
                right = nodes[k]["goal"] - s["below"] < s["below"] + weight - nodes[k]["goal"]
                nodes[k]["cut"] = (s["lo"][0], s["lo"][1] + (0 if right else 1))
                del state[k]


def split(pts: DataFrame, target_bytes: int | None = None, leaves: int | None = None) -> tuple[DataFrame, int]:
    """Adds column shard to the points, and tells how many shards there are: as many as leaves, or as target_bytes asks for."""
    ends = [f(c).alias(f"{a}_{c}") for c in DIMS for a, f in (("lo", F.min), ("hi", F.max))]
    r = pts.agg(F.sum("weight").alias("w"), *ends).first()
    total = r["w"] or 0
    if not total:
        return pts.withColumn("shard", F.lit(0)), 0
    spans = {c: r[f"hi_{c}"] - r[f"lo_{c}"] for c in DIMS}

    def heavier(limit: float) -> tuple[int, int]:
        n, w = pts.filter(F.col("weight") > limit).agg(F.count("*"), F.sum("weight")).first()
        return n, w or 0

    if leaves is None:
        limit = float(target_bytes)
        alone, apart = heavier(limit)
        shared = math.ceil((total - apart) / target_bytes)
    else:
        # What is set apart leaves less for the other leaves, so that more may be heavier than those.
        alone = apart = 0
        while True:
            limit = (total - apart) / (leaves - alone)
            n, w = heavier(limit)
            if n == alone:
                break
            alone, apart = n, w
        shared = leaves - alone
    tree = pts.withColumn("node", F.lit(0))
    if alone:
        number = F.row_number().over(Window.orderBy(F.desc("weight"), "k1", "k2")) - 1 + shared
        heavy = pts.filter(F.col("weight") > limit).withColumn("node", number)
        tree = cut(tree.filter(F.col("weight") <= limit).unionByName(heavy))
    #: A node is known by its first leaf's number; owed is its number of leaves.
    owed = {0: shared}
    for level in range(math.ceil(math.log2(shared)) if shared > 1 else 0):
        large = F.col("node").isin([k for k, n in owed.items() if n > 1])
        stats = {r["node"]: r for r in tree.filter(large).groupBy("node").agg(F.sum("weight").alias("w"), *ends).collect()}
        nodes = {}
        for k, r in stats.items():
            widest = max(range(len(DIMS)), key=lambda i: ((r[f"hi_{DIMS[i]}"] - r[f"lo_{DIMS[i]}"]) / max(1, spans[DIMS[i]]), -i))
            nodes[k] = {"dim": widest, "goal": r["w"] * (owed[k] // 2) / owed[k]}
        if not nodes:
            break
        _median(tree, nodes)
        moved = None
        for k, x in nodes.items():
            half = owed[k] // 2
            owed |= {k: half, k + half: owed[k] - half}
            d = F.col(DIMS[x["dim"]])
            left = (d < x["cut"][0]) | ((d == x["cut"][0]) & (F.col("tie") < x["cut"][1]))
            to = F.when(left, k).otherwise(k + half)
            moved = F.when(F.col("node") == k, to) if moved is None else moved.when(F.col("node") == k, to)
        tree = tree.withColumn("node", moved.otherwise(F.col("node")))
        if level % 4 == 3:
            tree = cut(tree)
    return tree.withColumn("shard", F.col("node").cast("int")).drop("node"), shared + alone


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard. rows: doc_id, size, text_crc32, shard.

    Equal rows are counted, their counts dealt in pieces, and the pieces placed within chunks of a shard, which start where the chunks before end; then each piece becomes rows again.
    """
    chunks = max(1, rows.count() // CHUNK_ROWS)
    same = rows.groupBy("shard", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    pieces = same.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK_ROWS).cast("long"))))
    pieces = pieces.withColumn("n", F.least(F.lit(CHUNK_ROWS).cast("long"), F.col("n") - F.col("piece") * CHUNK_ROWS))
    pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32", "piece"), F.lit(chunks)).cast("int"))
    order = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size", "piece")
    before = pieces.withColumn("before", F.sum("n").over(order) - F.col("n"))
    starts = pieces.groupBy("shard", "chunk").agg(F.sum("n").alias("held"))
    starts = starts.select("shard", "chunk", (F.sum("held").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("held")).alias("start"))
    at = F.col("start") + F.col("before")
    slot = F.explode(F.sequence(at, at + F.col("n") - 1)).alias("slot")
    return before.join(starts, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", slot)


def shard_documents(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """One row per document: its shard under the law `bytes`, and its slot there. With target_bytes, shards are as many as that asks for."""
    pts = cut(points(docs))
    split_pts, _ = split(pts, target_bytes, None if target_bytes else shards)
    d = docs.select("doc_id", _size(F.col("text")).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), *_key())
    # Only texts with copies can be hot keys; each of the others is its row's own, so the join is even but for those, which the optimizer splits.
    placed = cut(d.join(split_pts.select("k1", "k2", "shard"), ["k1", "k2"]).drop("k1", "k2"))
    out = with_slots(placed)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

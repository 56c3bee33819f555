"""N-gram Jaccard join: chosen-path candidate search, then an exact check.

Texts are sets of hashed word five-grams. Texts with the same set are one node. Each node has COORDS min-hashes, which stand for its set: two nodes agree in a coordinate with the probability of their Jaccard similarity.
A run starts with all nodes in one bucket and splits a bucket by the values of one or two coordinates that its path chooses at random, 1 / threshold on average, so that a pair at the threshold is kept together in one child on average. Buckets of one node go; buckets of at most LEAF nodes are compared all with all; larger ones are split again, unless they are dense: where nodes agree with one of them in DENSE of the coordinates on average, the bucket is mostly near copies, which no split parts. Dense buckets, and what is large after DEPTH splits, are compared all with all too, in pairs of blocks dealt to many tasks. Runs are repeated until a pair at the threshold has met with probability RECALL; all runs go through the same jobs.

A comparison emits no pairs but a star for each component of the nodes that agree in enough coordinates (four standard deviations below the threshold). The stars' components are small families; within each, all pairs are verified on whole sets, again in pairs of blocks, which yields every node's number of links and stars of true links. Their components are the classes.

Result: one row per document: doc_id, class_id (the least doc_id of the class), n_links (different other texts with a similarity of at least the threshold; equal texts count once), n_copies (other documents with the same text).
Edge cases: texts of one to four words are one n-gram; texts without words equal only equal texts; null counts as empty; rows without doc_id are in classes like others; repeated rows are copies; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut_small, unused
from factloom.llm.components import components
from factloom.operators.shared import made_once

WORDS = 5
THRESHOLD = 0.8
COORDS = 64
RECALL = 0.999
DEPTH = 6
LEAF = 96
DENSE = 0.4
#: Rows of a block: of sets, and of min-hashes, which are small.
BLOCK, SKETCH_BLOCK = 200, 800
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.reverse(text))


def word_hashes(text: Column) -> Column:
    """Words are runs of letters, marks and digits, in lower case."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> Iterator[np.ndarray]:
    """The set of hashed n-grams of each text, sorted, from the flat hashes of all words."""
    h = flat.view(np.uint64)
    if len(h) >= n:
        g = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            g = (g + h[k : len(h) - n + 1 + k]) * _MIX
            g ^= g >> np.uint64(29)
        g = _mix(g)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            x = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                x = _mix((x + h[k : k + 1]) * _MIX)
            yield x
        else:
            yield np.array([], dtype=np.uint64)


def sketch(s: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Min-hashes of a set, 32 bits each; long sets are taken in pieces."""
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 63, size=coords, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, size=coords, dtype=np.uint64)
    low = None
    for at in range(0, len(s), 4096):
        m = ((s[at : at + 4096, None] * a + b) >> np.uint64(32)).astype(np.uint32).min(axis=0)
        low = m if low is None else np.minimum(low, m)
    return low.view(np.int32)


def _lists(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat, offsets = _lists(b.column(2))
        s1, s2, n, out = [], [], [], []
        for s in shingle_sets(flat, offsets):
            n.append(len(s))
            s1.append(int(_mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            s2.append(int(_mix(s + _MIX).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            out.append(sketch(s) if len(s) else np.zeros(0, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n, pa.int32()), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "t", "s1", "s2", "n", "mh"])


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), s1 and s2 (the set's identity), n (its size), mh (its min-hashes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(text).alias("t"), word_hashes(text).alias("w"))
    d = d.mapInArrow(_sketched, "doc_id long, t long, s1 long, s2 long, n int, mh array<int>")
    return d.withColumn("s1", F.when(F.col("n") > 0, F.col("s1")).otherwise(F.col("t")))


def runs_for(recall: float, threshold: float, depth: int) -> tuple[int, float]:
    """Runs needed, and the probability of a second coordinate."""
    two = 1 / threshold - 1
    lost = 0.0
    for _ in range(depth):
        one = 1 - threshold * (1 - lost)
        lost = (1 - two) * one + two * one * one
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost))), two


def _stars(pairs: tuple[np.ndarray, np.ndarray], n: int) -> list[tuple[int, int]]:
    """The components of the graph with these edges among n nodes, each as a star around its first node."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(pairs[0].tolist(), pairs[1].tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(find(x), x) for x in range(n) if find(x) != x]


def by_group(df: DataFrame, key: str, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run() on the rows of each key, which are few. Partitions are read as streams, so many small groups cost little."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            k = t.column(key).to_numpy()
            at = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
            for a, z in zip(at, at[1:], strict=False):
                yield from run(t.slice(a, z - a)).to_batches()
            rest = t.slice(at[-1]).combine_chunks() if len(t) else None
        if rest is not None and len(rest):
            yield from run(rest).to_batches()

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(stream, schema)


def _alike(least: float) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        ids, first = np.unique(t.column("node").to_numpy(), return_index=True)
        m = _lists(t.column("mh"))[0].reshape(len(t), -1)[first]
        i, j = [], []
        for k in range(len(ids) - 1):
            close = np.flatnonzero((m[k + 1 :] == m[k]).sum(axis=1) >= least * m.shape[1])
            i.append(np.full(len(close), k))
            j.append(close + k + 1)
        edges = _stars((np.concatenate(i), np.concatenate(j)), len(ids)) if i else []
        return pa.table({"a": pa.array(ids[[e[0] for e in edges]] if edges else [], pa.int64()), "b": pa.array(ids[[e[1] for e in edges]] if edges else [], pa.int64())})

    return run


def _block_pairs(df: DataFrame, key: str, size: Column, id_: str, block: int) -> DataFrame:
    """Deals the rows of each key into blocks of about so many rows, or the root of the key's size where that is more, and each row to the pairs of blocks that its own is in; adds column pair."""
    blocks = F.ceil(size / F.greatest(F.lit(float(block)), F.sqrt(size.cast("double")))).cast("int")
    mine = F.pmod(F.xxhash64(id_), F.col("_blocks")).cast("int")
    df = df.withColumn("_blocks", blocks).withColumn("_mine", mine)
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = F.xxhash64(F.col(key), F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    return df.withColumn("pair", pair)


def candidates(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(a, b): stars of the nodes whose min-hashes agree. nodes: node, mh."""
    runs, two = runs_for(recall, threshold, DEPTH)
    rng = np.random.default_rng(2)
    least = threshold - 4 * math.sqrt(threshold * (1 - threshold) / COORDS)
    coords = [(r, int(i)) for r in range(runs) for i in rng.choice(COORDS, size=1 + int(rng.random() < two), replace=False)]
    paths = F.array(*(F.xxhash64(F.lit(r), F.lit(i), F.get("mh", F.lit(i))) for r, i in coords))
    rows = nodes.select("node", F.explode(F.array_distinct(paths)).alias("path"))
    leaves, dense = None, None
    for depth in range(DEPTH):
        counts = rows.groupBy("path").agg(F.count("*").alias("c")).filter("c >= 2")
        rows, _ = cut_small(rows.join(counts, "path"))
        leaf = rows.filter(F.col("c") <= LEAF).groupBy("path").agg(F.sort_array(F.collect_set("node")).alias("members")).select("members").distinct()
        leaves = leaf if leaves is None else leaves.union(leaf)
        large = rows.filter(F.col("c") > LEAF)
        if large.isEmpty():
            break
        marked, _ = cut_small(large.join(nodes, "node"))
        first = large.groupBy("path").agg(F.min("node").alias("node")).join(nodes, "node").select("path", F.col("mh").alias("lead"))
        agree = F.size(F.filter("mh", lambda x, i: x == F.get("lead", i))) / COORDS
        near = marked.join(first, "path").groupBy("path").agg((F.avg(agree) >= DENSE).alias("dense"))
        marked = marked.join(cut_small(near)[0], "path")
        full = marked if depth == DEPTH - 1 else marked.filter("dense")
        blocks = _block_pairs(full, "path", F.col("c"), "node", SKETCH_BLOCK).select("pair", "node")
        dense = blocks if dense is None else dense.union(blocks)
        large = marked.filter("not dense")
        if depth == DEPTH - 1 or large.isEmpty():
            break
        pick = lambda seed: F.pmod(F.xxhash64("path", F.lit(seed)), F.lit(COORDS)).cast("int")
        second = F.pmod(F.xxhash64("path", F.lit(2)), F.lit(1_000_000)) < int(two * 1_000_000)
        both = F.when(second, F.array(pick(0), pick(1))).otherwise(F.array(pick(0)))
        split = large.select("node", "path", "mh", F.explode(F.array_distinct(both)).alias("i"))
        rows, _ = cut_small(split.select("node", F.xxhash64("path", "i", F.get("mh", F.col("i"))).alias("path")).distinct())
    groups = leaves.distinct().select(F.xxhash64("members").alias("pair"), F.explode("members").alias("node"))
    if dense is not None:
        groups = groups.union(dense)
    return by_group(groups.join(nodes, "node").select("pair", "node", "mh"), "pair", _alike(least), "a long, b long")


def _verify(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        """Every pair of nodes of two blocks, or of one, by their whole sets."""
        ids, first = np.unique(t.column("node").to_numpy(), return_index=True)
        block, weight = t.column("_mine").to_numpy()[first], t.column("weight").to_numpy()[first]
        flat, offsets = _lists(t.column("s"))
        sets = [flat[offsets[k] : offsets[k + 1]] for k in first]
        size = np.array([len(s) for s in sets])
        two = block.min() != block.max()
        links = np.zeros(len(ids), dtype=np.int64)
        i, j = [], []
        # Postings of each n-gram; only those in two sets at least count.
        all_ = np.concatenate(sets)
        owner = np.repeat(np.arange(len(ids)), size)
        order = np.argsort(all_, kind="stable")
        g, o = all_[order], owner[order]
        new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        run_id = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(g))))
        shared = np.diff(np.append(new, len(g)))[run_id] >= 2
        col, row = run_id[shared], o[shared]
        _, col = np.unique(col, return_inverse=True)
        common = np.zeros((len(ids), len(ids)), dtype=np.float32)
        step = 8192
        by_col = np.searchsorted(col, np.arange(0, (col.max() + 1 if len(col) else 0) + step, step))
        for a, z in zip(by_col[:-1], by_col[1:], strict=True):
            m = np.zeros((len(ids), step), dtype=np.float32)
            m[row[a:z], col[a:z] % step] = 1
            common += m @ m.T
        for k in range(len(ids) - 1):
            rest = slice(k + 1, None)
            union = size[k] + size[rest] - common[k, rest]
            close = common[k, rest] >= threshold * union - 1e-9 * union
            if two:
                close &= block[rest] != block[k]
            found = np.flatnonzero(close) + k + 1
            links[k] += weight[found].sum()
            links[found] += weight[k]
            i.append(np.full(len(found), k))
            j.append(found)
        edges = _stars((np.concatenate(i), np.concatenate(j)), len(ids)) if i else []
        has = np.flatnonzero(links)
        n = len(has)
        return pa.table({"a": pa.array([*ids[has].tolist(), *ids[[e[0] for e in edges]].tolist()] if n else [], pa.int64()), "b": pa.array([None] * n + (ids[[e[1] for e in edges]].tolist() if edges else []), pa.int64()), "links": pa.array([*links[has].tolist(), *([0] * len(edges))], pa.int64())})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat, offsets = _lists(b.column(1))
        s = [x.view(np.int64) for x in shingle_sets(flat, offsets)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.list_(pa.int64()))], ["node", "s"])


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    d = made_once(sketched(docs))
    texts = d.groupBy("s1", "s2", "t").agg(F.min("doc_id").alias("d"), F.count("*").alias("c"))
    # A set's first hash is its node; both are compared wherever rows of a set meet.
    sets = made_once(texts.groupBy("s1", "s2").agg(F.min("d").alias("d"), F.count("*").alias("weight")).withColumn("node", F.col("s1")))
    nodes = made_once(d.filter("n > 0").groupBy(F.col("s1").alias("node")).agg(F.any_value("mh").alias("mh")))
    family = components(candidates(nodes, threshold, recall))
    family, _ = cut_small(family.join(sets.select(F.col("node").alias("id"), "weight", "s1", "s2"), "id").select(F.col("id").alias("node"), "root", "weight", "s1", "s2"))
    # The sets of these nodes alone are made again from their texts: one document of each.
    row_of = F.coalesce("doc_id", F.lit(-1).cast("long"))
    one = F.min(F.struct(row_of.alias("row"), "t")).alias("one")
    at = d.join(family.select("node", "s1", "s2"), ["s1", "s2"]).groupBy("node").agg(one).select("node", "one.row", "one.t")
    text = F.coalesce(F.col("text"), F.lit(""))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_hash(text).alias("t")).select(row_of.alias("row"), "text", "t")
    whole = at.join(text, ["row", "t"]).groupBy("node").agg(F.min("text").alias("text")).select("node", word_hashes(F.col("text")).alias("w")).mapInArrow(_sets, "node long, s array<bigint>")
    members = family.select("node", "root", "weight").join(family.groupBy("root").agg(F.count("*").alias("c")), "root").join(whole, "node")
    dealt = _block_pairs(members, "root", F.col("c"), "node", BLOCK).select("pair", "node", "_mine", "weight", "s")
    found, _ = cut_small(by_group(dealt, "pair", _verify(threshold), "a long, b long, links long"))
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(found.filter("b is not null").select("a", "b"))
    label, _ = cut_small(sets.join(classes.withColumnRenamed("id", "node"), "node").join(links, "node", "left").select("s1", "s2", "d", "root", "links"))
    label = label.join(label.groupBy("root").agg(F.min("d").alias("least")), "root").drop("d")
    same = texts.select("s1", "s2", "t", "c").join(sets.select("s1", "s2", "weight", F.col("d").alias("own"), "node"), ["s1", "s2"]).join(label, ["s1", "s2"], "left")
    same = same.select(
        "s1",
        "s2",
        "t",
        F.coalesce("root", "node").alias("class_key"),
        F.coalesce("least", "own", "root", "node").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        (F.col("c") - 1).cast("long").alias("n_copies"),
    )
    return d.select("doc_id", "s1", "s2", "t").join(same, ["s1", "s2", "t"]).select("doc_id", "class_id", "n_links", "n_copies", "class_key", F.col("t").alias("text_key"))


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The document of least doc_id of each class, with all its columns. Of rows with equal doc_id and text one stays."""
    rows = made_once(jaccard_join(docs, threshold, recall).groupBy("class_key", "doc_id", "text_key").agg(F.count("*").alias("n")))
    id_, t, n = (unused(docs, c) for c in ("_id", "_t", "_n"))
    no_id = F.lit(-(1 << 62)).cast("long")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("b")
    keep = rows.groupBy("class_key").agg(best).select(F.coalesce("b.doc_id", no_id).alias(id_), F.col("b.text_key").alias(t), F.col("b.n").alias(n))
    marked = docs.withColumns({t: text_hash(F.coalesce("text", F.lit(""))), id_: F.coalesce(F.col("doc_id").cast("long"), no_id)})
    kept = marked.join(keep, [id_, t])
    single = kept.filter(F.col(n) == 1).select(*docs.columns)
    return single.unionByName(kept.filter(F.col(n) > 1).dropDuplicates([id_, t]).select(*docs.columns))

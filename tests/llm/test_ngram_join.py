import re
from collections import defaultdict

import pytest
from helpers import DATA, ODD, docs

from factloom.llm.common import table
from factloom.llm.ngram_join import jaccard_join


def brute(rows):
    """(class, links, copies) of each row by comparing all pairs of texts that share an n-gram."""
    texts = {t or "" for _, t in rows}
    sets = {}
    for t in texts:
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        sets[t] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    post = defaultdict(list)
    for t, s in sets.items():
        for g in s:
            post[g].append(t)
    common = defaultdict(int)
    for ts in post.values():
        for a in ts:
            for b in ts:
                if a < b:
                    common[a, b] += 1
    up = {t: t for t in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = defaultdict(int)
    for (a, b), n in common.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            links[a] += 1
            links[b] += 1
            up[find(a)] = find(b)
    least, copies = {}, defaultdict(int)
    for d, t in rows:
        r = find(t or "")
        copies[t or ""] += 1
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((d, least.get(find(t or "")), links[t or ""], copies[t or ""] - 1) for d, t in rows if d is not None)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "class_id", "n_links", "n_copies").collect() if r[0] is not None)


def test_matches_brute_force_on_a_table(spark):
    df = table(spark, DATA, "documents")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert result(jaccard_join(df)) == brute(rows)


@pytest.fixture(scope="module")
def family():
    """300 near copies of one text, each with some words changed, and a common passage in texts that are otherwise unlike."""
    import random

    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base, passage = words(200), words(40)
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(words(80) + passage)) for i in range(300)]
    return rows


def test_large_family_and_common_passage(spark, family):
    assert result(jaccard_join(docs(spark, family))) == brute(family)


def test_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 7]
    df = docs(spark, rows)
    got = jaccard_join(df)
    assert got.count() == len(rows)
    assert result(got) == brute([r for r in rows if r[0] is not None])


def test_empty_table(spark):
    assert jaccard_join(docs(spark, [])).count() == 0


def test_pairs_in_hot_buckets_split_to_the_full_depth(spark, monkeypatch):
    """Pairs at the threshold among nodes that are otherwise unlike, but have only three values in each coordinate. LEAF is small and nothing is dense, so that a few thousand nodes go through as many splits as very hot buckets do."""
    import numpy as np

    from factloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "LEAF", 2)
    monkeypatch.setattr(ngram_join, "DENSE", 2.0)
    rng, pairs = np.random.default_rng(5), 1500
    x = rng.integers(0, 3, size=(pairs, 64), dtype=np.int32)
    y = x.copy()
    for i in range(pairs):
        y[i, rng.choice(64, size=12 + (i % 5 > 0), replace=False)] += 10 + i
    nodes = [(i, m.tolist()) for i, m in enumerate(np.concatenate([x, y]))]
    up = list(range(2 * pairs))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in ngram_join.candidates(spark.createDataFrame(nodes, "node long, mh array<int>")).collect():
        up[find(a)] = find(b)
    lost = sum(find(i) != find(pairs + i) for i in range(pairs))
    assert lost <= (1 - ngram_join.RECALL) * pairs


def test_small_tables_leave_few_files(spark):
    """A few rows dealt over many partitions: partitions without rows write nothing."""
    import os
    import tempfile

    from factloom.llm.common import cut_small

    before, at = spark.sparkContext.getCheckpointDir(), tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(at)
    try:
        c, n = cut_small(spark.range(3).repartition(64, "id"))
        files = [x for _, _, names in os.walk(at) for x in names if x.startswith("part-")]
        assert n == 3 and sorted(r["id"] for r in c.collect()) == [0, 1, 2] and len(files) <= 4
        assert c.rdd.getNumPartitions() == 1
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)

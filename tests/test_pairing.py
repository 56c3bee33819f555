import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import pairing
from factloom.operators.pairing import candidate_pairs, dealt, met, pairs_of_ids

SCHEMA = "id string, subject string, predicate string, value_type string, norm_num double, comparison_key string, source_document_id string, source_filename string, page_number int"


@pytest.fixture(autouse=True)
def key_by_subject(monkeypatch):
    """Whatever the predicate: two documents of one key may then share no predicate."""
    monkeypatch.setattr(pairing, "comparison_key", lambda s, p: F.concat(F.lower(s), F.lit("|")))


def fits(a, b):
    a, b = ("number" if t in ("numeric", "currency") else t for t in (a, b))
    return (a is not None and a == b) or "unknown" in (a, b)


def dist(x, y):
    if x is None or y is None:
        return 0, 0.0
    if not (math.isfinite(x) and math.isfinite(y)):
        return 1, 0.0
    return 0, abs(x - y) / max(abs(x), abs(y), 1.0)


def plain(rows):
    """Every pair of documents, every pair of facts."""
    rows = [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in dict.fromkeys(rows)]
    at = lambda f: (f["source_filename"], f["page_number"], f["id"])
    keys, out = {}, []
    for f in rows:
        if None not in (f["id"], f["subject"], f["predicate"], f["source_document_id"]):
            keys.setdefault(f["subject"].lower(), {}).setdefault(f["source_document_id"], []).append(f)
    for docs in keys.values():
        order = sorted(docs, key=lambda d: (min(map(at, docs[d])), d))
        for i, x in enumerate(order):
            for y in order[i + 1 :]:
                shared = {f["predicate"] for f in docs[x]} & {f["predicate"] for f in docs[y]}
                pairs = [(a, b) for a in docs[x] for b in docs[y] if fits(a["value_type"], b["value_type"])]
                if shared:
                    for p in shared:
                        c = [(dist(a["norm_num"], b["norm_num"]), at(a), at(b)) for a, b in pairs if a["predicate"] == b["predicate"] == p]
                        out += [(min(c)[1][2], min(c)[2][2])] if c else []
                else:
                    out += [(a["id"], b["id"]) for a, b in pairs]
    return sorted(out)


NUMBERS = [None, 0.0, -0.0, 1.0, -1.0, 0.5, 2.0, 3.0, -7.0, 100.0, 101.0, 1e20, -1e20, 1e17, float("inf"), float("-inf"), float("nan"), 1e-5]


def random_facts(seed, n=300, odd=True):
    r = random.Random(seed)
    kinds = ["numeric", "currency", "percentage", "unknown", "text", None] if odd else ["numeric", "currency", "percentage"]
    rows = []
    for i in range(n):
        d = r.randrange(6)
        number = r.choice(NUMBERS) if r.random() < (0.7 if odd else 0.2) else round(r.uniform(-50, 50), r.choice([0, 1, 4]))
        predicate = r.choice(["aa", "bb"]) if d < 4 else "cc" if d == 4 else r.choice(["dd", "aa"])
        rows.append((f"f{i:04}", r.choice("xyz"), predicate, r.choice(kinds), number, "", f"d{d}", f"n{d % 3}", r.randrange(3)))
    return rows


@pytest.mark.parametrize("seed,odd,small", [(1, True, 64), (1, True, 0), (2, False, 3), (3, False, 0), (4, True, 5)])
def test_against_plain(spark, seed, odd, small):
    rows = random_facts(seed, odd=odd)
    got = candidate_pairs(spark.createDataFrame(rows, SCHEMA), small).select("a.id", F.col("b.id").alias("b")).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_small_blocks_and_cells(spark, monkeypatch):
    rows = random_facts(9, 200)
    want = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    ids, one = pairing._all_pairs, pairing.dealt
    monkeypatch.setattr(pairing, "_all_pairs", lambda rest, n, docs: ids(rest, n, docs, 3))
    monkeypatch.setattr(pairing, "HOT", 0)
    monkeypatch.setattr(pairing, "dealt", lambda docs: one(docs, 2))
    assert sorted(map(tuple, candidate_pairs(df).select("a.id", F.col("b.id").alias("b")).collect())) == want


def test_a_group_of_two_long_lists(spark):
    """20,000 by 20,000 facts: 400 million pairs are never made."""
    n = 20_000
    side = F.when(F.col("id") < n, "a").otherwise("b")
    number = (F.xxhash64("id") % 10**12) / 1000 + F.when(F.col("id") < n, 0.0001).otherwise(0.0)
    facts = spark.range(2 * n).select(F.concat(F.lit("f"), "id").alias("id"), F.lit("Hot").alias("subject"), F.lit("p").alias("predicate"), F.lit("numeric").alias("value_type"), number.alias("norm_num"), F.lit("").alias("comparison_key"), side.alias("source_document_id"), side.alias("source_filename"), F.lit(1).alias("page_number"))
    r = candidate_pairs(facts).select("a.id", "a.norm_num", F.col("b.id").alias("b"), F.col("b.norm_num").alias("y")).collect()
    numbers = facts.select("source_document_id", "norm_num").collect()
    every = sorted((x["norm_num"], x["source_document_id"]) for x in numbers)
    # the closest by relative distance stand next to each other, but for signs, which differ by more here
    best = min(abs(x - y) / max(abs(x), abs(y), 1.0) for (x, s), (y, t) in zip(every, every[1:]) if s != t)
    assert len(r) == 1 and abs(r[0]["norm_num"] - r[0]["y"]) / max(abs(r[0]["norm_num"]), abs(r[0]["y"]), 1.0) == best


def test_a_key_with_most_documents_is_dealt(spark):
    """One key has nine of ten documents: each cell of its grid gets about the same."""
    docs = spark.range(2000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("_key"), F.concat(F.lit("d"), "id").alias("doc"), F.struct(F.col("id").alias("first")).alias("first"), F.array(F.lit("p")).alias("preds"), F.lit(1).alias("n"))
    d = dealt(docs, 100)
    grids = {r["_key"]: r["grid"] for r in d.select("_key", "grid").distinct().collect()}
    assert grids["hot"] == 18 and set(grids.values()) == {1, 18}
    own = d.filter("_key = 'hot'").groupBy(F.pmod(F.hash("doc"), "grid")).count().collect()
    assert max(r["count"] for r in own) < 2 * 100
    assert met(d).count() == 1800 * 1799 // 2 and met(d).select("da", "db").distinct().count() == 1800 * 1799 // 2


def test_facts_are_fetched_by_id(spark):
    """No other column of a fact goes through the joins that find pairs."""
    df = spark.createDataFrame(random_facts(3, 40), SCHEMA).withColumn("evidence_quote", F.lit("q"))
    assert "evidence_quote" not in pairs_of_ids(df)._jdf.queryExecution().optimizedPlan().toString()


def test_odd_rows(spark):
    fact = lambda i, d, **k: tuple({"id": i, "subject": "x", "predicate": "p", "value_type": "numeric", "norm_num": 1.0, "comparison_key": "old", "source_document_id": d, "source_filename": d, "page_number": 1, **k}.values())
    rows = [fact("a", "1"), fact("a", "1"), fact("b", "2"), fact("b", "2", norm_num=2.0), fact(None, "2"), fact("c", None), fact("d", "2", subject=None), fact("e", "3", predicate=None)]
    got = candidate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.a.id, r.b.id, r.b.norm_num, r.a.comparison_key) for r in got] == [("a", "b", 1.0, "x|")]
    both = [fact("a", "1"), fact("a", "1"), fact("b", "2", predicate="q"), fact("b", "2", predicate="q"), fact("b", "2", predicate="q", norm_num=2.0)]
    assert sorted((r.a.id, r.b.norm_num) for r in candidate_pairs(spark.createDataFrame(both, SCHEMA)).collect()) == [("a", 1.0), ("a", 2.0)]
    assert candidate_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed,odd", [(1, True), (2, False), (5, True)])
def test_keys_of_few_facts_against_plain(spark, seed, odd):
    rows = random_facts(seed, odd=odd)
    got = candidate_pairs(spark.createDataFrame(rows, SCHEMA), 1000).select("a.id", F.col("b.id").alias("b")).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_keys_of_few_and_of_many_facts_together(spark):
    rows = random_facts(6, 150) + [(f"g{i}", f"s{i // 2}", "aa", "numeric", float(i), "", f"d{i % 2}", f"n{i % 2}", 1) for i in range(40)]
    got = candidate_pairs(spark.createDataFrame(rows, SCHEMA), 20).select("a.id", F.col("b.id").alias("b")).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_facts_of_small_keys_move_once(spark):
    df = spark.createDataFrame(random_facts(3, 40), SCHEMA).withColumn("evidence_quote", F.lit("q"))
    plan = candidate_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan

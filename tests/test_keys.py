from pyspark.sql import functions as F
from test_facts import fact, facts

from factloom.functions.naming import comparison_key
from factloom.operators.pairing import candidate_pairs


def test_two_facts_of_a_key(spark):
    """The short way of keys with two facts: the same pairs as the long way makes."""
    rows = []
    for i, (da, db, pa, pb, ta, tb) in enumerate([("d1", "d2", "revenue", "revenue", "numeric", "currency"), ("d2", "d1", "revenue", "turnover", "numeric", "numeric"), ("d1", "d1", "revenue", "revenue", "numeric", "numeric"), ("d1", "d2", "revenue", "turnover", "text", "numeric"), ("d1", "d2", "revenue", "revenue", None, "unknown"), ("d1", "d2", "revenue", "revenue", None, "text")]):
        rows += [fact(f"a{i}", da, subject=f"S{i}", predicate=pa, value_type=ta, norm_num=1.0), fact(f"b{i}", db, subject=f"S{i}", predicate=pb, value_type=tb)]
    df = facts(spark, *rows)
    pairs = lambda p: sorted((r.a.id, r.b.id) for r in p.collect())
    found = pairs(candidate_pairs(df))
    assert found == pairs(candidate_pairs(df, small=1)) and sorted(map(sorted, found)) == [["a0", "b0"], ["a1", "b1"], ["a4", "b4"]]


def test_no_pattern_of_many_parts_in_keys(spark):
    """A class of ranges and a letter is slow to match, row by row (F4)."""
    said = str(comparison_key(F.col("subject"), F.col("predicate")))
    assert "[^a-z0-9_]" not in said and "translate" not in said
    odd = spark.createDataFrame([("The Acme, Ltd", "A-b C!"), ("Ünï é", "Ünï_é 9")], "subject string, predicate string")
    assert [r[0] for r in odd.select(comparison_key(F.col("subject"), F.col("predicate"))).collect()] == ["acme|a_b_c", "n|n__9"]

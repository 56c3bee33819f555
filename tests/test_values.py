import pytest
from pyspark.sql import functions as F

from factloom.functions.values import normalize_values, parse_values

PARSED = [
    ("₹81,415.38 million", 8141.538, "INR crore", "currency"),
    ("₹8,142 Cr", 8142.0, "INR crore", "currency"),
    ("12.68%", 12.68, "percent", "percentage"),
    ("18,793", 18793.0, "count", "numeric"),
    ("1,429K tonnes", 1.429, "million tonnes", "numeric"),
    ("J89,319Mn", 8931.9, "INR crore", "currency"),
    ("Pier No. 5, Dock 44, Seaford 122001", None, None, "text"),
    ("12 million customers", 1.2, "INR crore", "currency"),
    ("Seaford 122002", 122002.0, "count", "numeric"),
    ("Rs 5 lakh", 0.05, "INR crore", "currency"),
    ("5 lakh", 5.0, "lakh", "numeric"),
    ("$3 bn", 3000.0, "USD million", "currency"),
    ("Rs 3 bn", 300.0, "INR crore", "currency"),
    ("3 billion", 3.0, "billion", "numeric"),
    ("$4 crore", 4.0, "USD crore", "currency"),
    ("$4 mn", 4.0, "USD million", "currency"),
    ("7 million sq ft", 7.0, "million sq ft", "numeric"),
    ("7 million parcels", 7.0, "million parcels", "numeric"),
    ("-3.5 per cent", -3.5, "percent", "percentage"),
    ("10-15%", -15.0, "percent", "percentage"),
    ("March 31, 2024", 31.0, "count", "numeric"),
    ("code 7", 7.0, "pin_codes", "numeric"),
    ("$ 12", 12.0, "USD", "currency"),
    ("no numbers", None, None, "text"),
    ("", None, None, "unknown"),
    (None, None, None, "unknown"),
]


def test_parse(spark):
    df = parse_values(spark.createDataFrame([(i, r[0]) for i, r in enumerate(PARSED)], "i int, raw string"), "raw")
    got = {r[0]: (r[1], r[2], r[3]) for r in df.select("i", "value.num", "value.unit", "value.value_type").collect()}
    assert [got[i] for i in range(len(PARSED))] == [tuple(r[1:]) for r in PARSED]


CONTEXT = [
    ("8.932", "₹ Cr", "₹ Cr FY23 FY24 FY25 Revenue from services 7,224 8,142 8.932", None, 8932.0, None, "INR crore", "currency"),
    ("8.932", "INR crore", "revenue 8.932", "₹ Cr 7,224 8,142", 8932.0, None, "INR crore", "currency"),
    ("8,142", "₹ Cr", None, None, 8142.0, None, "INR", "currency"),
    ("81415.38", "INR million", None, None, 81415.38, None, "million", "numeric"),
    ("142", None, "Rs 8,142 Cr", None, 142.0, None, "INR crore", "currency"),
    ("6.5", None, "was 6.5 bn", None, 6.5, None, "billion", "numeric"),
    ("Member  of\nthe board", None, None, None, None, "Member of the board", "text", "text"),
    ("abc", "people", None, None, None, "abc", "people", "text"),
    (r"a\Eb 5", None, r"a\Eb 5 mn", None, 5.0, None, "million", "numeric"),
]


@pytest.mark.parametrize("at", range(len(CONTEXT)))
def test_normalize(spark, at):
    r = CONTEXT[at]
    df = spark.createDataFrame([r[:4]], "raw_value string, raw_unit string, evidence_quote string, source_context string")
    v = normalize_values(df).select("value.*").first()
    assert (v.num, v.text, v.unit, v.value_type) == r[4:]


def test_no_python_in_the_plan(spark):
    df = normalize_values(spark.range(3).select(F.col("id").cast("string").alias("raw_value"), F.lit("x").alias("raw_unit"), F.lit("q").alias("evidence_quote"), F.lit("c").alias("source_context")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_patterns_run_only_where_they_can_match(spark):
    """A value without any mark of a magnitude costs no pattern of one, and none is run for currencies."""
    plan = parse_values(spark.createDataFrame([("5",)], "raw string"), "raw")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?i)rs" not in plan and "(?i)\\$" not in plan
    assert plan.count("CASE WHEN Contains") + plan.count("CASE WHEN (Contains") >= 6
    odd = ["5 PER CENT", "5 Crores", "5 MN", "5 Lacs", "5 BILLION", "5K", "5 K", "rS5", "uSd 5", "İNR 5", "5 per  cent crore"]
    got = parse_values(spark.createDataFrame(list(enumerate(odd)), "i int, raw string"), "raw").orderBy("i").select("value.num", "value.unit").collect()
    assert [tuple(r) for r in got] == [(5.0, "percent"), (5.0, "INR crore"), (5.0, "million"), (5.0, "lakh"), (5.0, "billion"), (5000.0, "count"), (5000.0, "count"), (5.0, "INR"), (5.0, "USD"), (5.0, "count"), (5.0, "percent")]

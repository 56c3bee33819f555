"""Registered queries take every row, and all of it."""

from pyspark.sql import functions as F

from factloom.plans.catalog import QUERIES
from factloom.plans.synthetic import answers

LONG = " ".join(f"word{i}" for i in range(400))


def saved(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_answers_are_about_whole_texts(spark, tmp_path):
    rows = [(1, LONG), (2, LONG), (3, ""), (4, None), (5, "a short text of one line"), (10, "brief"), (6, "brief")]
    d = saved(spark, tmp_path, "documents", rows, "doc_id long, text string")
    assert {r.document_id: r.text for r in answers(spark, d).collect()} == {str(i): t or "" for i, t in rows}
    quotes = {r[0]: r[1] for r in answers(spark, d).select("document_id", F.regexp_extract("response", '"Net_Profit".*?"evidence_quote":"([^"]*)"', 1)).collect()}
    assert quotes == {"1": LONG[-80:-20], "2": LONG[10:70], "3": "", "4": "", "5": "a short text of one line"[10:], "10": "brief", "6": ""}
    got = {(r.source_document_id, r.predicate): r.is_grounded for r in QUERIES["facts_ingest"](spark, d).collect()}
    assert got == {(str(i), p): p == "net_profit" and i in (1, 2, 5, 10) for i, _ in rows for p in ("net_profit", "headcount")}
    events = [r.document_filename for r in QUERIES["failure_events"](spark, d).collect()]
    assert sorted(events) == sorted([f"doc-{i}" for i, _ in rows] + ["doc-3", "doc-4", "doc-6"])


def test_context_of_every_notation(spark, tmp_path):
    rows = [(k, (o - k) % 7, 1234.5, 12.0) for k in (105, 106, 107, 108, 109) for o in range(7)]
    d = saved(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double")
    got = {r.id: tuple(r)[1:] for r in QUERIES["normalize_context"](spark, d).collect()}
    each = [("₹1,234.50 million", 123.45, None, "INR crore", "currency"), ("₹1,234.50 Cr", 1234.5, None, "INR crore", "currency"), ("12.5%", 12.5, None, "percent", "percentage"), ("12K tonnes", 0.012, None, "million tonnes", "numeric"), ("$12 bn", 1200.0, None, "INR crore", "currency"), ("Rs 12 lakh", 0.12, None, "INR crore", "currency")]
    bare = [("1,234.50", 1234.5, None, "INR", "currency"), ("106", 106.0, None, "INR crore", "currency"), ("107", 107.0, None, "million", "numeric"), ("208.250", 208250.0, None, "INR crore", "currency"), ("109", 10900.0, None, "INR crore", "currency")]
    want = {k * 8 + n: bare[k % 5] if (n + k) % 7 == 6 else each[(n + k) % 7] for k, n, _, _ in rows}
    # Without a unit in rupees beside it, a value in dollars stays one.
    want |= {k * 8 + n: ("$12 bn", 12000.0, None, "USD million", "currency") for k, n, _, _ in rows if k % 5 == 4 and (n + k) % 7 == 4}
    assert got == want

"""Facts and raw values made from the driver's tables by fixed rules, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.naming import comparison_key


#: Text before and after a whole number, the factor of its value (None: not a number), whether the number stands there, unit and type.
NOTATIONS = (
    ("", " crore units", 1.0, True, "INR crore", "currency"),
    ("$", " crore", 1.0, True, "USD crore", "currency"),
    ("", " million tonnes", 1.0, True, "million tonnes", "numeric"),
    ("", " mn parcels", 1.0, True, "million parcels", "numeric"),
    ("", " million sq ft", 1.0, True, "million sq ft", "numeric"),
    ("", " mn visits", 1.0, True, "million", "numeric"),
    # The letters of rupees stand in the word.
    ("", " mn users", 0.1, True, "INR crore", "currency"),
    ("$", " million", 1.0, True, "USD million", "currency"),
    ("", " lakh", 1.0, True, "lakh", "numeric"),
    ("INR ", " bn", 100.0, True, "INR crore", "currency"),
    ("", " billion", 1.0, True, "billion", "numeric"),
    ("", " thousand", 1000.0, True, "count", "numeric"),
    ("Rs. ", "", 1.0, True, "INR", "currency"),
    ("USD ", "", 1.0, True, "USD", "currency"),
    ("", " pin", 1.0, True, "pin_codes", "numeric"),
    ("-", "", -1.0, True, "count", "numeric"),
    ("", " per cent", 1.0, True, "percent", "percentage"),
    ("J", "Mn", 0.1, True, "INR crore", "currency"),
    ("Plot ", " in a long road of the town", None, True, None, "text"),
    ("none at all", "", None, False, None, "text"),
    ("", "", None, False, None, "unknown"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and a raw value in one of seven notations, by line number and order."""
    li = _table(spark, sf_dir, "lineitem")
    v = F.format_number(F.round("l_extendedprice", 2), 2)
    kind = (F.col("l_linenumber") + F.col("l_orderkey")) % 7
    raw = (
        F.when(kind == 0, F.concat(F.lit("₹"), v, F.lit(" million")))
        .when(kind == 1, F.concat(F.lit("₹"), v, F.lit(" Cr")))
        .when(kind == 2, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5%")))
        .when(kind == 3, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("K tonnes")))
        .when(kind == 4, F.concat(F.lit("$"), F.col("l_quantity").cast("int").cast("string"), F.lit(" bn")))
        .when(kind == 5, F.concat(F.lit("Rs "), F.col("l_quantity").cast("int").cast("string"), F.lit(" lakh")))
        .otherwise(v)
    )
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), raw.alias("raw_value"))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents that report each order's value: the orders, and their line items. Exact decimals keep sums the same on any engine."""
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    d = lambda c, t: F.col(c).cast(t)
    line = d("l_extendedprice", "decimal(12,2)") * (1 - d("l_discount", "decimal(4,2)")) * (1 + d("l_tax", "decimal(4,2)"))
    b = items.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(line).alias("v"), F.max(F.year("l_shipdate")).alias("y"))
    a = orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(12,2)").alias("v"), F.year("o_orderdate").alias("y"))
    subject = F.concat(F.lit("Order "), F.col("k").cast("string"), F.lit(" Limited"))
    period = F.concat(F.lit("FY"), F.lpad((F.col("y") % 100).cast("string"), 2, "0"))

    def facts(df: DataFrame, side: str, predicate, scope, number) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"{side}-"), F.col("k").cast("string")).alias("id"),
            subject.alias("subject"),
            predicate.alias("predicate"),
            F.concat(F.lit("value of "), F.col("k").cast("string")).alias("raw_value"),
            number.alias("norm_num"),
            F.lit(None).cast("string").alias("norm_text"),
            F.lit("currency").alias("value_type"),
            F.lit("USD").alias("unit"),
            period.alias("time_period"),
            scope.alias("scope"),
            F.lit(None).cast("string").alias("qualifiers"),
            comparison_key(subject, predicate).alias("comparison_key"),
            F.lit(f"doc-{side}").alias("source_document_id"),
            F.lit(f"{side}.pdf").alias("source_filename"),
            (F.col("k") % 40 + 1).cast("int").alias("page_number"),
            F.concat(F.lit("order "), F.col("k").cast("string")).alias("evidence_quote"),
            (F.col("k") % 11 != 0).alias("is_grounded"),
            F.when(F.col("k") % 11 != 0, F.lit(1.0)).otherwise(F.lit(0.2)).alias("grounding_score"),
            F.when(F.col("k") % 11 != 0, F.lit(1.0)).otherwise(F.lit(0.2)).alias("confidence"),
            F.when(F.col("k") % 11 == 0, F.lit("UNGROUNDED: not found")).alias("extraction_notes"),
        )

    third = F.col("k") % 3
    pa = F.when(third == 0, F.lit("total_revenue")).otherwise(F.lit("revenue_from_services"))
    pb = F.when(third == 1, F.lit("annual_turnover")).when(third == 0, F.lit("total_revenue")).otherwise(F.lit("revenue_from_services"))
    scope_b = F.when(F.col("k") % 13 == 0, F.lit("standalone")).otherwise(F.lit("consolidated"))
    return facts(a, "A", pa, F.lit("consolidated"), F.round("v", 2).cast("double")).unionByName(facts(b, "B", pb, scope_b, F.round("v", 2).cast("double")))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's value in one document, and each of its lines' prices under the same predicate in another."""
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    part = lambda df, doc, k, i, v: df.select(F.concat(F.lit(f"{doc}-"), k.cast("string"), F.lit("-"), i.cast("string")).alias("id"), F.concat(F.lit("Order "), k.cast("string")).alias("subject"), F.lit("net_income").alias("predicate"), F.lit("").alias("comparison_key"), v.alias("norm_num"), F.lit("currency").alias("value_type"), F.lit(f"doc-{doc}").alias("source_document_id"), F.lit(f"{doc}.pdf").alias("source_filename"), i.cast("int").alias("page_number"))
    a = part(orders, "A", F.col("o_orderkey"), F.lit(1), F.col("o_totalprice"))
    b = part(items, "B", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice"))
    return a.unionByName(b)


def text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and directorships that two documents report for each customer."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))

    def facts(doc: str, predicate: str, text) -> DataFrame:
        none = F.lit(None).cast("string")
        return c.select(
            F.concat(F.lit(f"{doc}-{predicate}-"), F.col("k").cast("string")).alias("id"), F.col("name").alias("subject"), F.lit(predicate).alias("predicate"), text.alias("raw_value"), F.lit(None).cast("double").alias("norm_num"), text.alias("norm_text"), F.lit("text").alias("value_type"), none.alias("unit"), none.alias("time_period"), none.alias("scope"), none.alias("qualifiers"), F.lit("").alias("comparison_key"),
            F.lit(f"doc-{doc}").alias("source_document_id"), F.lit(f"{doc}.pdf").alias("source_filename"), F.lit(1).alias("page_number"), text.alias("evidence_quote"), F.lit(True).alias("is_grounded"), F.lit(1.0).alias("grounding_score"), F.lit(1.0).alias("confidence"), none.alias("extraction_notes"),
        )

    pin = lambda shift: F.concat(F.lit("Plot 5, Long Road, City "), (F.lit(100000) + (F.col("k") + shift) % 900).cast("string"))
    moved = F.when(F.col("k") % 4 == 0, 1).otherwise(0)
    left = F.when(F.col("k") % 3 == 0, F.lit("Resigned from the board")).otherwise(F.lit("Member of the board"))
    return facts("A", "office_address", pin(F.lit(0))).unionByName(facts("B", "office_address", pin(moved))).unionByName(facts("A", "board_director", F.lit("Member of the board"))).unionByName(facts("B", "board_director", left))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer about each document's whole text, short, empty and missing ones too: a quote from near its begin or, for every third, its end, one that is made up, and for some no JSON at all. Without text the first quote is empty."""
    d = _table(spark, sf_dir, "documents")
    page = F.coalesce("text", F.lit(""))
    late = F.substring(page, F.greatest(F.length(page) - 79, F.lit(1)), F.lit(60))
    quote = F.when(F.col("doc_id") % 3 == 1, late).otherwise(F.substring(page, 11, 60))
    item = lambda predicate, value, quote: F.struct(F.lit("The Company Ltd").alias("subject"), F.lit(predicate).alias("predicate"), value.alias("raw_value"), F.lit("").alias("unit"), quote.alias("evidence_quote"))
    value = F.concat((F.col("doc_id") % 500).cast("string"), F.lit(" million"))
    good = F.to_json(F.struct(F.array(item("Net_Profit", F.concat(F.lit("Rs "), value), quote), item("headcount", (F.col("doc_id") % 1000).cast("string"), F.lit("nothing like this stands anywhere on the page"))).alias("facts")))
    fenced = F.concat(F.lit("```json\n"), good, F.lit("\n```"))
    response = F.when(F.col("doc_id") % 10 == 7, F.lit("I cannot answer")).when(F.col("doc_id") % 10 == 8, F.lit('{"facts": [{"subject": 5}]}')).when(F.col("doc_id") % 2 == 0, fenced).otherwise(good)
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_filename"), F.lit(1).alias("page_number"), page.alias("text"), response.alias("response"))

"""What a reader of the fact layer asks for: filters, searches, counts and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.schemas import RELATIONSHIP_TYPES

ALL_DOCUMENTS, ALL_TYPES = "All Documents", "All"


def _holds(columns, keyword: str) -> Column:
    """Whether a column holds the keyword, whatever its case; % and _ are ordinary characters."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(keyword.lower())) for c in columns))


def search_facts(facts: DataFrame, keyword: str = "", filename: str = ALL_DOCUMENTS, grounded: bool | None = None) -> DataFrame:
    if filename != ALL_DOCUMENTS:
        facts = facts.filter(F.col("source_filename") == filename)
    if grounded is not None:
        facts = facts.filter("is_grounded" if grounded else "not is_grounded")
    return facts.filter(_holds(("predicate", "subject", "raw_value"), keyword)) if keyword else facts


def search_relationships(edges: DataFrame, keyword: str = "", kind: str = ALL_TYPES) -> DataFrame:
    """The keyword is looked for in the first fact and the explanation."""
    if kind != ALL_TYPES:
        edges = edges.filter(F.col("relationship_type") == kind)
    return edges.filter(_holds(("fact_a.subject", "fact_a.predicate", "short_explanation"), keyword)) if keyword else edges


def relationship_counts(edges: DataFrame) -> DataFrame:
    return edges.agg(*(F.count_if(F.col("relationship_type") == t).alias(t.lower()) for t in RELATIONSHIP_TYPES))


def corpus_metrics(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """documents, facts, grounded and grounded_percent in one row."""
    f = facts.agg(F.count("*").alias("facts"), F.count_if("is_grounded").alias("grounded"))
    d = documents.agg(F.count("*").alias("documents"))
    share = F.round(F.col("grounded") / F.greatest(F.col("facts"), F.lit(1)) * 100, 1)
    return d.withColumn("_one", F.lit(1)).join(f.withColumn("_one", F.lit(1)), "_one").select("documents", "facts", "grounded", share.alias("grounded_percent"))


def document_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("source_document_id").agg(F.count("*").alias("extracted"), F.count_if("is_grounded").alias("grounded"))


def summary(facts: DataFrame, edges: DataFrame) -> DataFrame:
    f = facts.agg(F.countDistinct("source_document_id").alias("documents_count"), F.count("*").alias("facts_count"), F.count_if("is_grounded").alias("grounded_facts_count"))
    e = edges.agg(F.count("*").alias("relationships_count"), *(F.count_if(F.col("relationship_type") == t).alias(f"{t.lower()}_count") for t in RELATIONSHIP_TYPES))
    return f.withColumn("_one", F.lit(1)).join(e.withColumn("_one", F.lit(1)), "_one").drop("_one")


def provenance_check(facts: DataFrame) -> DataFrame:
    """Whether there are facts, grounded ones among them, and all have a source, a page and a quote."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    every = has("source_filename") & F.coalesce(F.col("page_number") >= 1, F.lit(False)) & has("evidence_quote")
    return facts.agg((F.count("*") > 0).alias("any_facts"), (F.count_if("is_grounded") > 0).alias("any_grounded"), F.coalesce(F.bool_and(every), F.lit(True)).alias("all_sourced"))


def first_facts(facts: DataFrame, n: int) -> DataFrame:
    return facts.orderBy("source_filename", "page_number", "id").limit(n)


def _or(c: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)).alias(c)


def fact_cards(facts: DataFrame) -> DataFrame:
    """Facts as they are shown: defaults for what is missing, confidence as whole percent, the quote cut."""
    return facts.select("id", "subject", "predicate", "raw_value", _or("unit", "none"), _or("time_period", "N/A"), _or("scope", "General"), _or("qualifiers", "None"), (F.col("confidence") * 100).cast("int").alias("confidence_percent"), F.substring("evidence_quote", 1, 90).alias("quote"))


def document_audit(documents: DataFrame) -> DataFrame:
    return documents.select("id", "filename", F.col("page_count").alias("pages"), "processed_pages", F.col("extracted_facts_count").alias("facts"), F.col("grounded_facts_count").alias("grounded"), "status", F.size("warnings").alias("warnings"))


def event_audit(events: DataFrame) -> DataFrame:
    return events.select(F.col("document_filename").alias("document"), F.col("page_number").alias("page"), F.col("failure_type").alias("type"), F.col("what_happened").alias("what"), F.col("why_it_happened").alias("why"), F.col("how_handled").alias("handling"), F.col("future_improvement").alias("improvement"))

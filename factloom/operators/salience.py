"""The most informative pages of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that tell of figures and offices, and the points of each sign.
KEYWORDS = ("revenue", "turnover", "ebitda", "profit", "workforce", "employee", "team size", "pin code", "pincode", "shipment", "parcel", "tonnage", "freight", "active customer", "corporate office", "registered office", "director", "resigned", "gdp", "inflation")
FOOTNOTES = ("(1)", "footnote", "as of march 31")
MAX_NUMBERS, KEYWORD_POINTS, FIRST_PAGES, FIRST_POINTS, FOOTNOTE_POINTS = 30, 5, 3, 25, 15
MIN_CHARS, MAX_PAGES = 100, 15


def salience(text: Column, page: Column) -> Column:
    low = F.lower(text)
    points = F.least(F.regexp_count(text, F.lit(r"\b\d+(?:,\d+)*(?:\.\d+)?\b")), F.lit(MAX_NUMBERS))
    for k in KEYWORDS:
        points = points + F.when(F.contains(low, F.lit(k)), KEYWORD_POINTS).otherwise(0)
    noted = F.contains(low, F.lit(FOOTNOTES[0])) | F.contains(low, F.lit(FOOTNOTES[1])) | F.contains(low, F.lit(FOOTNOTES[2]))
    return points + F.when(page <= FIRST_PAGES, FIRST_POINTS).otherwise(0) + F.when(noted, FOOTNOTE_POINTS).otherwise(0)


def salient_pages(pages: DataFrame, k: int = MAX_PAGES) -> DataFrame:
    """All pages of documents of at most k; of others the k pages with most points among those that are long enough, lower numbers first among equals."""
    counts = pages.groupBy("document_id").agg(F.count("*").alias("_n"))
    scored = pages.withColumn("_score", F.when(F.col("char_count") >= MIN_CHARS, salience(F.col("text"), F.col("page_number")))).join(counts, "document_id")
    best = Window.partitionBy("document_id").orderBy(F.col("_score").desc_nulls_last(), "page_number")
    ranked = scored.withColumn("_rank", F.row_number().over(best))
    return ranked.filter((F.col("_n") <= k) | (F.col("_score").isNotNull() & (F.col("_rank") <= k))).select(*pages.columns)

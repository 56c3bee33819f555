"""Checks of a quote against the page that it is said to come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import missing, or_empty, settled, strip

MIN_OVERLAP = 0.70
#: Shares of single tokens and of runs of three in the score.
TOKEN_SHARE, RUN_SHARE = 0.4, 0.6


def matching_form(c: Column) -> Column:
    """Straight quotes and dashes, no soft hyphens, Rs for the rupee sign, no footnote marks, single blanks, lower case."""
    plain = F.replace(F.translate(or_empty(c), "“”‘’–—­", "\"\"''--"), F.lit("₹"), F.lit("Rs"))
    unmarked = F.regexp_replace(plain, r"(?U)\(\s*\d+(?:\s*,\s*\d+)*\s*\)", " ")
    return F.lower(strip(F.regexp_replace(unmarked, r"(?U)\s+", " ")))


def ground(df: DataFrame, page: str = "page_text", quote: str = "evidence_quote", out: str = "grounding", page_form: str | None = None, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Adds out: struct(is_grounded, score, note, is_whole); is_whole tells a quote that stands on the page from one whose parts all do. page_form is a column with the page's matching form, where it was made once for many quotes."""
    keep = [c for c in df.columns if c != out]
    df = df.withColumns({"_q": strip(or_empty(F.col(quote))), "_pf": F.col(page_form) if page_form else matching_form(F.col(page))})
    df = df.withColumn("_qf", matching_form(F.col("_q")))
    q, pf, qf = F.col("_q"), F.col("_pf"), F.col("_qf")
    verdict = lambda ok, score, note, whole=False: F.struct(F.lit(ok).alias("is_grounded"), score.cast("double").alias("score"), note.alias("note"), F.lit(whole).alias("is_whole"))
    # Only what neither form of the quote settles gets tokens.
    sure = missing(F.col(quote)) | missing(F.col(page)) | F.contains(F.col(page), q) | F.contains(pf, qf)
    df = df.withColumn("_t", F.when(~sure, F.filter(F.split(qf, " "), lambda x: F.length(x) > 1)))
    t = F.col("_t")
    df = df.withColumns({"_lost": F.array_except(t, F.split(pf, " ")), "_runs": F.when(F.size(t) >= 3, F.transform(F.sequence(F.lit(1), F.size(t) - 2), lambda i: F.array_join(F.slice(t, i, 3), " ")))})
    hits = F.size(F.filter(t, lambda x: ~F.array_contains(F.col("_lost"), x))) / F.size(t)
    runs = F.size(F.filter("_runs", lambda x: F.contains(pf, x))) / F.size("_runs")
    df = df.withColumn("_score", F.when(F.size(t) >= 3, TOKEN_SHARE * hits + RUN_SHARE * runs).when(F.size(t) > 0, hits))
    score = F.col("_score")
    percent = F.round(score * 100, 1).cast("string")
    result = (
        F.when(missing(F.col(quote)) | missing(F.col(page)), verdict(False, F.lit(0.0), F.lit("No quote, or no page")))
        .when(F.contains(F.col(page), q), verdict(True, F.lit(1.0), q, True))
        .when(F.contains(pf, qf), verdict(True, F.lit(1.0), qf, True))
        .when(score.isNull(), verdict(False, F.lit(0.0), F.lit("The quote has no words to look for")))
        .when(score >= min_overlap, verdict(True, F.round(score, 3), F.concat(F.lit("Found in parts: "), percent, F.lit("% of the quote"))))
        .otherwise(verdict(False, F.round(score, 3), F.concat(F.lit("Ungrounded: "), percent, F.lit("% of the quote is on the page"))))
    )
    return settled(df, keep, result, ("is_grounded", "score", "note", "is_whole"), out)

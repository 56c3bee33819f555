"""A corpus pipeline: language, toxicity, near duplicates, packing.

Each stage gets (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of docs; the last returns the packed pieces.
Edge cases: a null, empty or letterless text is in no language, so the first stage rejects it; equal texts are one class, of which the row of least doc_id stays (a missing doc_id counts as the greatest); of repeated rows one stays; extra columns, whatever their names, go along; an empty table gives no pieces. Only doc_id, text, lang (for training) and labels are read.

A stage's result is written as Parquet to the folder that driver and executors share and read again, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import shared_dir, table, unused

#: A document whose most likely language is less likely than this is rejected, like one without letters.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no known language."""
    from factloom.llm.language import UNKNOWN, train, with_language

    label, score = unused(docs, "_lang_pred"), unused(docs, "_lang_score")
    marked = with_language(docs, train(docs), label, score)
    return marked.filter((F.col(label) != UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches the threshold."""
    from factloom.llm.toxicity import THRESHOLD, train, with_toxicity

    score = unused(docs, "_toxicity")
    return with_toxicity(docs, train(docs, table(spark, sf_dir, "labels")), score).filter(F.col(score) < THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    from factloom.llm.ngram_join import one_of_each_class

    return one_of_each_class(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences: one row per piece."""
    import public_tokenizers

    from factloom.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]
#: SQL can't express these stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
    return docs

"""Quality rules: fixed counts of a text and a hashed n-gram log-likelihood ratio.

The method compares two multinomials over hashed word uni- and bigrams: one of a trusted target (documents labelled as good), one of the raw corpus.
The score of a document is the sum of its n-grams' log ratios over their number plus PRIOR, so very short texts stay near zero. Every document is kept or not by one fixed threshold.

Edge cases: a null text has no words and fails the base rules; an empty target gives weights near zero; equal rows get equal results; extra columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, double_array, settled

BUCKETS = 1 << 15
PRIOR = 16
THRESHOLD = -0.045
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Bound of the labelled documents that the target is counted on. The raw corpus is always counted whole.
TARGET_DOCS = 20_000
#: Occurrences added to a bucket's count in the target and to the count expected there at the raw corpus's rate.
SMOOTHING = 20.0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _bigrams(h: Column) -> Column:
    """Hashes of neighbouring pairs; h must be a column that is used at least twice, else it would be computed again for each element."""
    return F.when(F.size(h) >= 2, F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))).otherwise(F.array().cast("array<bigint>"))


def ngram_counts(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): counts over all documents, and over those whose doc_id is in target_ids (a small table, see TARGET_DOCS)."""
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(target_ids.select("doc_id", F.lit(1).alias("trusted"))), "doc_id", "left")
    h = marked.select("trusted", _hashes(words_of(F.col("text"))).alias("h"))
    grams = h.select("trusted", F.explode(F.concat("h", _bigrams(F.col("h")))).alias("g"))
    return grams.groupBy(F.col("g").bitwiseAND(buckets - 1).cast("int").alias("bucket")).agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))


def target_documents(labels: DataFrame, most: int = TARGET_DOCS) -> DataFrame:
    """The trusted documents by the hash of their ids, at most `most`."""
    good = labels.filter("quality = 1").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def weights(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """Log ratio by bucket; `buckets` numbers at most reach the driver."""
    raw, target = [0] * buckets, [0] * buckets
    for b, r, t in counts.collect():
        raw[b], target[b] = r, t
    share = sum(target) / max(1, sum(raw))
    return [round(math.log((t + smoothing) / (share * r + smoothing)), 6) for r, t in zip(raw, target, strict=True)]


def score(docs: DataFrame, llr: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the base counts, base_failed, llr_score and kept. One pass without a shuffle."""
    buckets = len(llr)
    table = double_array(llr)
    weight = lambda g: F.get(table, g.bitwiseAND(buckets - 1).cast("int"))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"), words_of(F.col("text")).alias("words"))
    d = d.select(
        "doc_id",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _hashes(F.col("words")).alias("h"),
        "words",
    )
    h, words = F.col("h"), F.col("words")
    # A window's hash keeps its upper bits; the lower ones hold its position, so one sort of longs brings windows together that may be equal.
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.size(h) + F.lit(1.0)))).cast("int")
    d = d.withColumns({"bits": bits, "low": F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1).cast("long")})
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(F.bitwise_not(F.col("low"))).bitwiseOR(i.cast("long")))
    d = d.withColumns({"sorted": F.sort_array(F.when(F.size(h) >= 3, windows).otherwise(F.array().cast("array<bigint>"))), "pairs": _bigrams(h)})
    s = F.col("sorted")
    same = lambda x, y: F.coalesce(F.call_function("shiftrightunsigned", x.bitwiseXOR(y), F.col("bits")) == 0, F.lit(False))
    d = d.withColumn("total", F.aggregate("h", F.lit(0.0), lambda a, g: a + weight(g)) + F.aggregate("pairs", F.lit(0.0), lambda a, g: a + weight(g)))
    kept = ("doc_id", "n_symbols", "n_words", "word_chars", "n_dup_lines")
    d = d.select(*kept, "words", "low", "total", (F.size("h") + F.size("pairs")).alias("n_grams"), F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))).alias("maybe"))
    # Only these are compared word by word; words hold no blanks, so windows joined by one are equal only if their words are.
    at = lambda x: x.bitwiseAND(F.col("low")).cast("int")
    d = d.select(*kept, "total", "n_grams", F.sort_array(F.transform("maybe", lambda x: F.struct(F.array_join(F.slice(words, at(x) + 1, 3), " ").alias("w"), at(x).alias("p")))).alias("maybe"))
    m = F.col("maybe")
    equal = lambda x, k: F.coalesce(x["w"] == F.get(m, k)["w"], F.lit(False))
    d = d.withColumn("at", F.sort_array(F.transform(F.filter(m, lambda x, k: equal(x, k - 1) | equal(x, k + 1)), lambda x: x["p"])))
    at = F.col("at")
    # Each repeated window adds the words up to the next one's start, three at most.
    repeat = F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.when(F.size(at) > 0, repeat).otherwise(F.lit(0).cast("long")))
    d = d.withColumns({"base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")), "llr_score": F.round(F.col("total") / (F.col("n_grams") + PRIOR), 9)})
    results = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
    verdict = ~F.col("base_failed") & (F.col("llr_score") >= threshold)
    return settled(d, ["doc_id"], results | {"kept": verdict, "llr_score": F.col("llr_score")})


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Fits the two multinomials and scores every document."""
    counts = ngram_counts(docs, cut(target_documents(labels)), buckets)
    return score(docs, weights(counts, buckets), threshold)

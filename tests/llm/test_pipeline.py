"""The pipeline's stages, each on what the one before it kept, against plain versions; odd rows, clashing names and empty tables."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from helpers import DATA, ODD, docs
from pyspark.sql import functions as F
from test_ngram_join import brute
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import language, toxicity
from factloom.llm.common import table


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_language(spark, df):
    m = language.train(df)
    keep = lambda t: t is not None and any(c.isalpha() for c in t) and m.probabilities(m.vector(t)).max() >= corpus_pipeline.MIN_LANGUAGE_SCORE
    return [tuple(r) for r in df.collect() if keep(r.text)]


def plain_toxicity(spark, df):
    s = toxicity.train(df, table(spark, DATA, "labels")).prepare()
    return [tuple(r) for r in df.collect() if s.score(r.text) < toxicity.THRESHOLD]


def plain_near_duplicates(spark, df):
    rows = df.collect()
    keep = {d for d, least, _, _ in brute([(r.doc_id, r.text) for r in rows]) if d == least}
    return [tuple(r) for r in rows if r.doc_id in keep]


def check_packed(pieces, df):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in df.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for parts in (*by_doc.values(), *by_sequence.values()):
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    assert {d: sum(n for _, n in x) for d, x in by_doc.items()} == {d: len(x) for d, x in ids.items()}


def test_stages_against_plain_versions(spark, tmp_path):
    df = table(spark, DATA, "documents")
    before = df.count()
    plain = {"language": plain_language, "toxicity": plain_toxicity, "near_duplicates": plain_near_duplicates}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, DATA)
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        want = plain[name](spark, df)
        df = spark.read.parquet(str(tmp_path / name))
        assert rows_of(df) == sorted(want, key=str), name
    assert 0.5 * before < df.count() < before
    check_packed(corpus_pipeline.packing(spark, df, DATA).collect(), df)


#: One label to learn, repeated rows, and a text that differs in case alone.
TIES = [(20, "alpha beta gamma delta epsilon zeta eta theta", "xx", "s"), (20, "alpha beta gamma delta epsilon zeta eta theta", "xx", "s"), (19, "Alpha beta gamma delta epsilon zeta eta theta", "xx", "s")]


@pytest.mark.parametrize("names", [(), ("_t", "_id", "_n", "_lang_pred", "_lang_score", "_toxicity", "t", "n", "score", "node", "class_id")])
def test_odd_rows_and_clashing_names(spark, names):
    odd = docs(spark, ODD + TIES)
    for i, c in enumerate(names):
        odd = odd.withColumn(c, F.lit(i))
    by = dict(corpus_pipeline.STAGES)
    kept = by["language"](spark, odd, DATA)
    # One label alone is learned, so every text with a letter is kept, and none without.
    assert kept.columns == odd.columns and not kept.filter("text is null or doc_id in (2, 3)").count() and kept.filter("doc_id = 20").count() == 2
    assert rows_of(by["toxicity"](spark, odd, DATA)) == rows_of(odd)
    one = by["near_duplicates"](spark, odd, DATA)
    assert one.columns == odd.columns
    # Null and empty texts are equal; so are the two of ids 5 and 6, the repeated rows, and texts that differ in case.
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in one.collect()) == sorted((d is None, d or 0, t or "") for d, t in [ODD[0], *ODD[2:4], *ODD[5:8], *ODD[9:], TIES[2][:2]])
    assert one.filter("doc_id = 19").select(*names).first() == (tuple(range(len(names))) if names else one.filter("doc_id = 19").select().first())
    assert by["packing"](spark, odd, DATA).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def test_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), DATA).count() == 0

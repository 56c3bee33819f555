"""Small inputs that every operator has to bear."""

from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *([None] * (4 - len(r))), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


#: Nulls, empty and blank texts, ties, repeated rows, odd characters, a very long text.
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (4, "two words"), (None, "no id here"), (5, "a b c d e f g"), (6, "a b c d e f g"), (7, "éß 漢字 🙂 \x1c x y"), (8, "long word " * 30_000), (9, "x" * 5_000)]

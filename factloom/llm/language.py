"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; everything but letters counts as one blank. n-grams of one to three characters are hashed; those that are frequent in the training sample are features, weighted by log(1 + count) and inverse document frequency and scaled to length 1.
The weights are learned by follow-the-regularised-leader with an L1 and an L2 penalty, which leaves most of them zero. A temperature, fitted on a part of the sample that the weights have not seen, makes the scores probabilities.

The sample is bounded: about DOCS_PER_LANGUAGE documents of each label, whatever their number, which like the model grows with the labels and not with the documents. Predictions read whole texts.
Edge cases: a null text or one without letters is `und` with score 0; with no labelled rows every text is `und`; repeated rows get equal predictions; columns of the input other than doc_id and text play no part.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS_PER_LANGUAGE = 600
FEATURES = 6000
HASH_BITS = 18
L1, L2, ALPHA, BETA = 0.3, 0.5, 0.5, 1.0
EPOCHS = 3
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Characters that are handled at a time.
CHUNK = 500_000


@functools.cache
def _letters() -> np.ndarray:
    """Every code point to itself where it is a letter, else to a blank."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32)


def has_letter(text: str) -> bool:
    # Python's word characters hold numerals such as 2 raised or Roman ones too, which are no letters.
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams of a text."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _letters()[c]
    c = c[(c != 32) | np.concatenate(([True], c[:-1] != 32))]
    top = np.uint32(32 - HASH_BITS)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
    return np.concatenate([one >> top, two >> top, three >> top])


@dataclass
class Model:
    labels: list[str]
    feature: np.ndarray  # of each hash, or -1
    idf: np.ndarray
    weights: np.ndarray  # features by labels
    bias: np.ndarray
    temperature: float = 1.0

    def counts(self, text: str) -> np.ndarray:
        total = np.zeros(len(self.idf), dtype=np.float64)
        for at in range(0, max(1, len(text)), CHUNK):
            f = self.feature[grams(text[at : at + CHUNK])]
            total += np.bincount(f[f >= 0], minlength=len(total))
        return total

    def vector(self, text: str) -> np.ndarray:
        x = np.log1p(self.counts(text)) * self.idf
        n = np.sqrt((x * x).sum())
        return x / n if n else x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """A model from a sample in a fixed order; every fifth text is left for the temperature."""
    names = sorted(set(labels))
    if not names:
        return None
    df = np.zeros(1 << HASH_BITS, dtype=np.int64)
    for t in texts:
        df[np.unique(grams(t))] += 1
    chosen = np.sort(np.argsort(-df, kind="stable")[:FEATURES])
    chosen = chosen[df[chosen] > 0]
    feature = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    feature[chosen] = np.arange(len(chosen))
    idf = np.log((1 + len(texts)) / (1 + df[chosen])) + 1
    k = len(names)
    m = Model(names, feature, idf, np.zeros((len(chosen), k)), np.zeros(k))
    # Only what is not zero is kept of each text.
    x = []
    for t in texts:
        v = m.vector(t)
        at = np.flatnonzero(v).astype(np.int32)
        x.append((at, v[at].astype(np.float32)))
    y = np.array([names.index(v) for v in labels])
    held = np.arange(len(texts)) % 5 == 4
    z, n = np.zeros((len(chosen) + 1, k)), np.zeros((len(chosen) + 1, k))
    rng = np.random.default_rng(0)

    def leader(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    train = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            at = np.append(x[i][0], len(chosen))
            v = np.append(x[i][1], 1.0)
            w = leader(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = leader(np.arange(len(chosen) + 1))
    m.weights, m.bias = w[:-1], w[-1]
    if held.any():
        logits = np.array([x[i][1] @ m.weights[x[i][0]] + m.bias for i in np.flatnonzero(held)])
        best = min(np.geomspace(0.05, 5, 41), key=lambda t: _loss(logits / t, y[held]))
        m.temperature = float(best)
    return m


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    top = logits.max(axis=1, keepdims=True)
    return float((np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0] - logits[np.arange(len(y)), y]).mean())


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """Fits on about per_language labelled documents of each language, chosen by the hash of their ids; those with fold 2 of 4 are left out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2))
    rate = known.groupBy("lang").agg((F.lit(per_language) / F.count("*")).alias("rate"))
    share = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = known.join(F.broadcast(rate), "lang").filter(share < F.col("rate")).select("doc_id", "lang", "text").collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
    rows = [r for r in rows if has_letter(r[2])]
    return fit([r[2] for r in rows], [r[1] for r in rows])


def with_language(docs: DataFrame, model: Model | None, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its calibrated probability to all columns of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, scores = [], []
            for t in b.column(at).to_pylist():
                if m is None or t is None or not has_letter(t):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = m.probabilities(m.vector(t))
                k = int(p.argmax())
                names.append(m.labels[k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, label, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; the model is learned from docs itself."""
    d = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return with_language(d, train(docs)).drop("text")

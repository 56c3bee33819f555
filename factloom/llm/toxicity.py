"""Toxicity: Levenshtein automata over a lexicon trie, and the context of what they find.

The lexicon is learned from labelled documents. A term is a word that stands in toxic documents only, or nearly, beside many different words, so that copies of one text teach nothing. A stem is the beginning of many such words.
Terms and stems form a trie. Words of a text run through the intersection of that trie with the Levenshtein automaton of one edit, made deterministic as it is used, so a word is read once whatever the lexicon's size and most are left after a few letters. A term may be one edit away, also where it begins with a stem; a stem must be met exactly, with any ending.
Each place is looked at in a window of WINDOW characters: within quotation marks, or after a word of reporting, it counts as quoted. A logistic regression weighs plain, misspelled and quoted places against each other.

The labelled sample is bounded by MAX_LABELLED documents of each label, and the lexicon by that sample's words; scores read whole texts of all documents.
Edge cases: null and empty texts have no places and get the score of that; with no labelled rows the lexicon is empty and all scores are 0; repeated rows get equal scores; columns of the input other than doc_id and text play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.language import fold

MAX_LABELLED = 8000
WINDOW = 60
STEM_LENGTHS = (4, 10)
#: A term's or stem's share of toxic documents is so many times its share of the others, at least.
LIFT = 25.0
MIN_CONTEXTS, MIN_STEM_WORDS = 4, 5
THRESHOLD = 0.7
WORD = re.compile(r"[^\W_]+")
#: Words and results that a worker keeps at most.
KEPT = 300_000
#: Words before a report of what someone said.
REPORTING = frozenset("said says say wrote writes quote quoted quoting called calls term word dijo dice escribió palabra sagte sagt schrieb wort dit disait écrit mot".split())
PAIRS = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}


class Automaton:
    """The words within one edit of a term, and those that begin with a stem."""

    PLAIN, MISSPELLED, STEM = 1, 2, 3

    def __init__(self, terms: list[str], stems: list[str], min_fuzzy: int = 5):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, int] = {}
        self.stem: set[int] = set()
        self.min_fuzzy = min_fuzzy
        for words, stem in ((terms, False), (stems, True)):
            for w in words:
                at = 0
                for c in w:
                    nxt = self.children[at].get(c)
                    if nxt is None:
                        nxt = len(self.children)
                        self.children.append({})
                        self.children[at][c] = nxt
                    at = nxt
                if stem:
                    self.stem.add(at)
                else:
                    self.term[at] = len(w)
        # A state is a set of (trie node, edits); numbers by set, and what each accepts.
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.open: list[bool] = []
        self.start = self._state({(0, 0)})

    def _state(self, raw: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        todo = list(raw)
        while todo:
            node, e = todo.pop()
            if least.get(node, 9) <= e:
                continue
            least[node] = e
            if e == 0:
                todo += [(child, 1) for child in self.children[node].values()]  # a letter of the term is left out
        key = frozenset(least.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            exact = any(e == 0 and n in self.term for n, e in key)
            near = any(n in self.term and self.term[n] >= self.min_fuzzy for n, e in key)
            self.accepts.append(self.PLAIN if exact else self.MISSPELLED if near else 0)
            self.open.append(any(e == 0 and n in self.stem for n, e in key))
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, e))
            if e == 0:
                out.add((node, 1))  # a letter too many
                out |= {(x, 1) for x in self.children[node].values()}  # another letter
        to = self._state(out) if out else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> int:
        s = self.start
        for c in word:
            nxt = self.moves[s].get(c)
            s = self._move(s, c) if nxt is None else nxt
            if s < 0:
                return 0
            if self.open[s]:
                return self.STEM
        return self.accepts[s]


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the place is within quotation marks, or shortly after a word of reporting, in its window."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    for a, z in PAIRS.items():
        if z in after and (before.count(a) % 2 == 1 if a == z else before.rfind(a) > before.rfind(z)):
            return True
    return any(w in REPORTING for w in WORD.findall(before)[-3:])


@dataclass
class Scorer:
    terms: list[str]
    stems: list[str]
    weights: list[float] = field(default_factory=lambda: [0.0] * 5)
    bias: float = -50.0

    def prepare(self) -> Scorer:
        self.automaton = Automaton(self.terms, self.stems)
        self.seen: dict[str, int] = {}
        return self

    def features(self, text: str) -> list[float]:
        """log(1 + n) of plain, misspelled and stem places, of quoted ones, and of places to a thousand words."""
        low = text.lower()
        words = WORD.findall(low)
        distinct = set(words)
        if len(self.seen) > KEPT:
            self.seen.clear()
        hits = {}
        for w in distinct:
            k = self.seen.get(w)
            if k is None:
                k = self.seen[w] = self.automaton.match(w)
            if k:
                hits[w] = k
        n = [0, 0, 0, 0]
        if hits:
            for m in re.finditer(r"(?<![^\W_])(?:" + "|".join(map(re.escape, hits)) + r")(?![^\W_])", low):
                n[3 if quoted(low, m.start(), m.end()) else hits[m[0]] - 1] += 1
        total = sum(n)
        return [*np.log1p(n).tolist(), float(np.log1p(1000 * total / max(50, len(words))))]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights, self.features(text or ""))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 200) -> tuple[list[float], float]:
    """Logistic regression by Newton's method, both labels weighing the same; more places never make a text less toxic, so negative weights become zero."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    free = np.ones(x1.shape[1], dtype=bool)
    w = np.zeros(x1.shape[1])
    for _ in range(x1.shape[1]):
        w[:] = 0
        for _ in range(steps):
            a = x1[:, free]
            p = 1 / (1 + np.exp(-np.clip(a @ w[free], -40, 40)))
            ridge = np.full(free.sum(), penalty / 10)
            g = a.T @ (weight * (p - y)) + ridge * w[free]
            h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
            step = np.linalg.solve(h, g)
            w[free] -= step
            if np.abs(step).max() < 1e-8:
                break
        bad = free & (w < 0)
        bad[-1] = False
        if not bad.any():
            break
        free &= ~bad
    w[~free] = 0
    return w[:-1].tolist(), float(w[-1])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of the bounded sample; fold 1 of 3 is left out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = dict(known.groupBy("toxic").count().collect())
    share = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("toxic") == 1, F.lit(MAX_LABELLED / max(1, sizes.get(1, 0)))).otherwise(F.lit(MAX_LABELLED / max(1, sizes.get(0, 0))))
    chosen = known.filter(share < rate).orderBy("doc_id").limit(3 * MAX_LABELLED)
    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Terms and stems."""
    texts = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    w = texts.select("toxic", F.split(F.lower("text"), r"[^\p{L}\p{N}]+").alias("w")).select("toxic", F.posexplode("w").alias("i", "word"), "w")
    w = w.select("toxic", "word", F.get("w", F.col("i") - 1).alias("before")).filter(F.length("word") >= 3)
    pairs = w.groupBy("word", "before").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("n"))
    words = pairs.groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum((F.col("p") > 0).cast("int")).alias("contexts"))
    sizes = w.agg(F.sum((F.col("toxic") == 1).cast("int")), F.sum((F.col("toxic") != 1).cast("int"))).first()
    toxic, other = max(1, sizes[0] or 0), max(1, sizes[1] or 0)
    lift = (F.col("p") + 0.0) / toxic * other / (F.col("n") + 0.5)
    good = (F.col("contexts") >= MIN_CONTEXTS) & (lift >= LIFT)
    stems = words.filter(F.length("word") >= STEM_LENGTHS[0]).select("p", "n", "contexts", "word", F.explode(F.sequence(F.lit(STEM_LENGTHS[0]), F.least(F.length("word"), F.lit(STEM_LENGTHS[1])))).alias("k"))
    stems = stems.groupBy(F.expr("substring(word, 1, k)").alias("stem")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.least("contexts", F.lit(3))).alias("contexts"), F.count_if(F.col("p") > 0).alias("kinds"), F.max(F.col("p")).alias("most"))
    # Many words, none of which makes up the stem alone.
    stems = stems.filter((F.col("kinds") >= MIN_STEM_WORDS) & (F.col("contexts") >= 2 * MIN_CONTEXTS) & (2 * F.col("most") <= F.col("p")) & (lift >= LIFT))
    found = [r[0] for r in words.filter(good).orderBy(F.desc("p"), "word").select("word").collect()]
    roots: list[str] = []
    for s in sorted((r[0] for r in stems.orderBy(F.desc("p"), "stem").select("stem").collect()), key=lambda s: (len(s), s)):
        if not any(s.startswith(r) for r in roots):
            roots.append(s)
    return sorted(found), roots


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    from factloom.llm.common import cut

    sample = cut(labelled(docs, labels))
    scorer = Scorer(*lexicon(sample))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value.prepare()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "toxic int, x array<double>").collect()
    y = np.array([r[0] for r in rows])
    if len(set(y.tolist())) == 2:
        scorer.weights, scorer.bias = fit_weights(np.array([r[1] for r in rows]), y)
    return scorer


def with_toxicity(docs: DataFrame, scorer: Scorer, score: str = "score") -> DataFrame:
    """Adds the score to all columns of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value.prepare()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s.score(t) for t in b.column(at).to_pylist()], pa.float64())], [*b.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    d = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    return with_toxicity(d, train(docs, labels)).drop("text").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

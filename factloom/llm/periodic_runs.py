"""Periodic run detection: stretches of words that repeat with a period, by the Gusfield-Stoye method.

A run is a maximal stretch of consecutive words with smallest period q, of at least max(6, 4 q) words. For the words of each text, all squares (tandem repeats) are found in time linear in the words but for logarithms:

1. The text is cut into Lempel-Ziv blocks. For each block and each period, one pair of longest common extensions, forward and backward, at a border of the block tells whether a square crosses it: the leftmost covering set of squares.
2. The vocabulary of squares is completed by walks along suffix links: from the locus of a square ax..ax to that of x..ax, and on by a where the tree has it, until the walk meets what is known. On one occurrence a walk goes on while its stretch lasts, so a walk is taken stretch by stretch.
3. Every square of the vocabulary is located: its occurrences are the leaves below its locus. Occurrences of one period that follow each other merge into runs.

The suffix tree is the suffix array with its intervals of common prefixes; common extensions come from the names of the blocks of 2^k words that prefix doubling gives while it sorts. Only squares with a primitive root are kept, which bounds occurrences by n log n (of a^n all but aa are left out) and makes the period of a run its smallest.

Every word of a run occurs in it four times at least. So the text is first cut at words that occur less than four times in their stretch, until nothing changes; stretches of under six words hold no run. Ordinary prose mostly ends there, whatever is left goes through the method, all stretches of some texts at a time, with symbols that no two stretches share.

Cases with a defined result: a null or empty text has no words and no runs; ties of the longest run go to the smallest start, then period; rows with a null or repeated doc_id are each judged alone; other columns, whatever their names, are not read. A text has to fit a task's memory, at about 200 bytes for each word left after cutting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 6, 4
#: Words that are judged at a time.
CHUNK = 200_000

Edit = Callable[[int | None, list[bytes]], list[bytes]]


def frequent(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch of each): what is left of the words after cutting at those that occur less than four times in their stretch. words and text: number of each word and of its text."""
    at = np.arange(len(words))
    stretch, size = text, -1
    while len(at) and len(at) != size:
        size = len(at)
        _, inverse, n = np.unique(stretch * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        keep = n[inverse] >= TIMES
        at = at[keep]
        if not len(at):
            break
        stretch = np.concatenate(([0], np.cumsum((np.diff(at) != 1) | (np.diff(stretch[keep]) != 0))))
        keep = np.bincount(stretch)[stretch] >= LEAST
        at, stretch = at[keep], stretch[keep]
    return at, stretch[: len(at)]


class Words:
    """A sequence of symbols, its last one like no other: names of blocks of 2^k symbols, suffix array, common prefixes."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        _, names = np.unique(symbols, return_inverse=True)
        self.names = [names.astype(np.int32)]
        while int(names.max()) + 1 < self.n:
            step = 1 << (len(self.names) - 1)
            after = np.zeros(self.n, np.int64)
            after[: self.n - step] = names[step:] + 1
            _, names = np.unique(names.astype(np.int64) * (self.n + 1) + after, return_inverse=True)
            self.names.append(names.astype(np.int32))
        #: With all names different, they are the ranks of the suffixes. No two blocks of that size are equal.
        self.rank = self.names.pop().astype(np.int64) if len(self.names) > 1 else names.astype(np.int64)
        self.order = np.argsort(self.rank)
        self.symbols = symbols

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, i < j."""
        i, j = i.copy(), j.copy()
        begin = j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            a = self.names[k]
            # an equal block ends before the last symbol, so both places stay inside
            same = a[np.minimum(i, self.n - 1)] == a[np.minimum(j, self.n - 1)]
            i += same.astype(np.int64) << k
            j += same.astype(np.int64) << k
        return j - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of what ends with the symbols at i and j, i < j; nothing where i is -1."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            a, size = self.names[k], 1 << k
            x, y = i - size + 1, j - size + 1
            same = (x >= 0) & (a[np.maximum(x, 0)] == a[np.maximum(y, 0)])
            i -= same.astype(np.int64) << k
            j -= same.astype(np.int64) << k
        return begin - i

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks and the end: each block is the longest piece that also begins earlier, or a new symbol."""
        n, order = self.n, self.order.tolist()
        before, after = [-1] * (n + 1), [-1] * (n + 1)
        for x, y in zip(order, order[1:]):
            before[y], after[x] = x, y
        last, first = [-1] * n, [-1] * n
        for i in range(n - 1, -1, -1):  # neighbours in the suffix array among earlier places
            x, y = before[i], after[i]
            last[i], first[i] = x, y
            after[x] = y
            before[y] = x
        longest = np.zeros(n, np.int64)
        here = np.arange(n)
        for other in (np.array(last), np.array(first)):
            some = other >= 0
            longest[some] = np.maximum(longest[some], self.forward(other[some], here[some]))
        steps, starts, i = longest.tolist(), [], 0
        while i < n:
            starts.append(i)
            i += steps[i] or 1
        return np.array([*starts, n])

    def interval(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that begin with the depth symbols at a place: the locus of that string."""
        ends = []
        for sign in (-1, 1):
            r = self.rank[at]
            for k in range(int(self.n).bit_length(), -1, -1):
                there = r + sign * (1 << k)
                inside = (there >= 0) & (there < self.n)
                other = self.order[np.clip(there, 0, self.n - 1)]
                same = inside & (other != at)
                same[same] = self.forward(np.minimum(at, other)[same], np.maximum(at, other)[same]) >= depth[same]
                r = np.where(same, there, r)
            ends.append(r)
        return ends[0], ends[1]

    def with_next(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """A place where the string of an interval goes on by a symbol, or -1. Suffixes of an interval are in order of the symbol that follows."""
        names = self.names[0]
        low, end = low.copy(), high + 1
        while (low < end).any():
            middle = (low + end) // 2
            here = self.order[np.minimum(middle, self.n - 1)] + depth
            less = (low < end) & (names[np.minimum(here, self.n - 1)] < symbol)
            end = np.where((low < end) & ~less, middle, end)
            low = np.where(less, middle + 1, low)
        found = low <= high
        at = self.order[np.minimum(low, self.n - 1)]
        return np.where(found & (names[np.minimum(at + depth, self.n - 1)] == symbol), at, -1)


def covering(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of a leftmost covering set of squares."""
    cut = w.blocks()
    begin, end = cut[:-1], cut[1:]
    size = end - begin
    out = []
    for border, length, ahead in ((end, size, False), (begin, size + np.append(size[1:], 0), True)):
        k = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + 1
        b, limit = np.repeat(border, length), np.repeat(end, length)
        q = b + k if ahead else b - k
        inside = (q < w.n) & (b < w.n)
        k, b, q, limit = k[inside], b[inside], q[inside], limit[inside]
        low, high = np.minimum(b, q), np.maximum(b, q)
        right = w.forward(low, high)
        left = w.backward(low - 1, high - 1)
        start = np.maximum(low - left, low - k + 1)
        good = (right + left >= k) & (right > 0)
        if ahead:
            good &= (left > 0) & (start + k <= limit)
        out.append((start[good], k[good]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def primitive(w: Words, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the root of each square is no power: it has no period that is the whole one over a prime."""
    good = np.ones(len(start), bool)
    rest = period.copy()
    p = 2
    while len(rest) and (rest > 1).any():
        prime = np.where(rest % p == 0, p, 0)
        if p * p > rest.max():
            prime = np.where(rest > 1, rest, 0)  # what is left of each is a prime
        some = np.flatnonzero(prime)
        if len(some):
            d = period[some] // prime[some]
            good[some] &= w.forward(start[some], start[some] + d) < 2 * period[some] - d
            while (more := (prime > 1) & (rest % np.maximum(prime, 2) == 0)).any():
                rest[more] //= prime[more]
        p += 1 if p == 2 else 2
    return good


def _pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.stack((x, y), axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n numbers for each."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def vocabulary(w: Words, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rank, last rank, period) of the loci of all squares, from a covering set: every stretch that a walk meets gives its rotations."""
    known: set[tuple[int, int]] = set()
    loci = []
    while len(start):
        left = start - w.backward(start - 1, start + period - 1)
        left, k = _pairs(left, period)
        new = np.array([x not in known for x in zip(left.tolist(), k.tolist())], dtype=bool)
        left, k = left[new], k[new]
        if not len(left):
            break
        known.update(zip(left.tolist(), k.tolist()))
        squares = w.forward(left, left + k) - k + 1
        rotations = np.minimum(squares, k)
        at, of = _ranges(left, rotations), np.repeat(k, rotations)
        loci.append(np.stack((*w.interval(at, 2 * of), of), axis=1))
        # the suffix link of a stretch's last square, then its first symbol
        last = left + squares - 1
        low, high = w.interval(last + 1, 2 * k - 1)
        there = w.with_next(low, high, 2 * k - 1, w.names[0][last])
        start, period = there[there >= 0], k[there >= 0]
    every = np.unique(np.concatenate(loci), axis=0) if loci else np.zeros((0, 3), np.int64)
    return every[:, 0], every[:, 1], every[:, 2]


def runs_in(symbols: np.ndarray) -> np.ndarray:
    """start, length, period of each maximal stretch that holds a square; the last symbol is like no other."""
    w = Words(symbols)
    start, period = _pairs(*covering(w))
    good = primitive(w, start, period)
    low, high, k = vocabulary(w, start[good], period[good])
    n = high - low + 1
    at, of = w.order[_ranges(low, n)], np.repeat(k, n)
    of, at = _pairs(of, at)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(of) != 0) | (np.diff(at) != 1))))
    count = np.diff(np.append(new, len(at)))
    return np.stack((at[new], count + 2 * of[new] - 1, of[new]), axis=1)


def find_runs(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """start (among all words), length and period of the runs of some texts, by start and period."""
    at, stretch = frequent(words, text)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    _, symbols = np.unique(stretch * (int(words.max()) + 1) + words[at], return_inverse=True)
    # between stretches, and at the end, a symbol that nothing else has
    breaks = np.append(np.flatnonzero(np.diff(stretch) != 0) + 1, len(at))
    mixed = np.insert(symbols, breaks, int(symbols.max()) + 1 + np.arange(len(breaks)))
    places = np.insert(at, breaks, -1)
    found = runs_in(mixed)
    found = found[found[:, 1] >= np.maximum(LEAST, TIMES * found[:, 2])]
    found[:, 0] = places[found[:, 0]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _told(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    words = np.array([numbers.setdefault(x, len(numbers)) for t in texts for x in t], dtype=np.int64)
    found = find_runs(words, np.repeat(np.arange(len(texts)), sizes)) if len(words) else np.zeros((0, 3), np.int64)
    edge = np.zeros(int(starts[-1]) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(edge)[:-1] == 0
    first = np.searchsorted(found[:, 0], starts)
    runs, collapsed = [], []
    for i, t in enumerate(texts):
        own = found[first[i] : first[i + 1]]
        runs.append([{"start": a - int(starts[i]), "length": n, "period": q} for a, n, q in own.tolist()])
        collapsed.append(b" ".join(compress(t, kept[starts[i] : starts[i + 1]].tolist()) if len(own) else t))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(runs, RUN), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, n_words, runs (in order of start, then period) and collapsed (the words of which no run says that they repeat) of each row. edit changes the words of a row before they are judged. A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, n = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                # bytes.split() parts words at space and the five controls from tab to carriage return, as the pattern does
                words = t.as_py().split() if t.is_valid else []
                ids.append(i)
                texts.append(edit(i, words) if edit else words)
                n += len(texts[-1])
                if n >= CHUNK:
                    yield _told(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield _told(ids, texts)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest (ties: smallest start, then period) and hashes."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).selectExpr(
        "doc_id", "n_runs", "-best.start as start", "best.length as length", "-best.period as period", "1000 * best.length div -best.period as exponent_milli", "runs_sha256", "collapsed_sha256"
    )

"""Substring dedup: words covered by a window of consecutive words that also starts elsewhere are taken out.

Three passes over the texts, each a map, with two grouped shuffles between them:

1. Every task counts anchors into a count-min sketch of two rows. A window's anchor is its least-hash run of GRAM words; equal windows have equal anchors, and two places of a window have their anchors at two places, so an anchor's count is never below its window's. Anchors are a tenth of the windows, and so are sketches. Partition sketches are merged by adding up equal cells; of the merged sketch one bit for each cell, whether its count is two or more, is broadcast.
2. Windows whose estimate is two or more are grouped by 128 bits of hash and counted exactly; each task first adds up its own. Nothing repeated is lost, since the sketch overestimates. What comes out are the few windows that were estimated repeated and occur once, with their place.
3. Windows estimated repeated, without those of the second pass, cover the words to take out.

The sketch has four cells for each expected anchor and row, up to 2^MAX_BITS cells a row (64 MB as bits). Beyond that it only estimates more windows as repeated, and the second pass groups more; results are the same.

Cases with a defined result: a null text has no words; texts of fewer words than a window keep all; repeated rows and equal texts are repeats of each other (the whole text goes, if it has a window); a null or repeated doc_id changes nothing, since windows are judged by place; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut

WIDTH, GRAM = 35, 16
MAX_BITS = 29
#: Words of one chunk of texts, sketch entries that a task holds, distinct words that it remembers.
CHUNK, HELD, KNOWN = 300_000, 2_000_000, 1_000_000
#: Windows wrongly estimated, up to which their places are broadcast.
BROADCAST_ROWS = 200_000
#: A text is among the commonest if at least one row in so many has it; there are at most so many of them.
COMMON = 1000
_ROWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Symbols(dict):
    """Words to numbers, and two 64-bit hashes of each."""

    def __init__(self) -> None:
        super().__init__()
        self.digests = bytearray()

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.digests += blake2b(word, digest_size=16).digest()
        return n

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """words x 2"""
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        out = np.frombuffer(bytes(self.digests), dtype="<u8").reshape(-1, 2)[ids]
        if len(self) > KNOWN:
            self.clear()
            self.digests.clear()
        return out


def sliding(op, x: np.ndarray, size: int) -> np.ndarray:
    """op over every size consecutive values."""
    have = 1
    while have * 2 <= size:
        x, have = op(x[:-have], x[have:]), have * 2
    return op(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        x = np.full(n, base, dtype=np.uint64)
        x[:1] = 1
        _POWERS[base] = np.multiply.accumulate(x)
    return _POWERS[base][:n]


def run_hashes(symbols: np.ndarray, base: int, size: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every size consecutive symbols."""
    n = len(symbols)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * _powers(base, n), dtype=np.uint64)))
    return (total[size:] - total[:-size]) * _powers(pow(base, -1, 1 << 64), n)[: n - size + 1]


class Chunk:
    """The words of some texts one after the other, and what is known of their windows."""

    def __init__(self, texts: list[list[bytes]], symbols: Symbols, width: int, gram: int):
        self.texts = texts
        self.width = width
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.n = int(self.starts[-1])
        if self.n < width:
            self.inside = np.zeros(0, bool)
            self.least = np.zeros(0, np.uint64)
            self.grams = np.zeros(0, np.uint64)
            return
        self.symbols = symbols.hashes([w for t in texts for w in t])
        ends = np.repeat(self.starts[1:], self.sizes)
        #: Whether a window begins at a word and ends within its text.
        self.inside = np.arange(self.n - width + 1) + width <= ends[: self.n - width + 1]
        self.grams = run_hashes(self.symbols[:, 0], _BASES[0], gram) | np.uint64(1)
        self.least = sliding(np.minimum, self.grams, width - gram + 1)

    def anchors(self) -> np.ndarray:
        """Hashes of the runs that are the least of a window, one for each place."""
        if not self.inside.any():
            return self.grams[:0]
        span = len(self.grams) - len(self.least) + 1
        of_windows = np.where(self.inside, self.least, np.uint64(0))
        edge = np.zeros(span - 1, np.uint64)
        return self.grams[sliding(np.maximum, np.concatenate((edge, of_windows, edge)), span) == self.grams]

    def estimated(self, sketch: Sketch) -> np.ndarray:
        """Places of windows whose count may be two or more."""
        at = np.flatnonzero(self.inside)
        return at[sketch.repeated(self.least[at])]

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = (run_hashes(self.symbols[:, i], _BASES[i], self.width)[at] for i in (0, 1))
        return one.view(np.int64), two.view(np.int64)


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each hash in each row; rows follow each other."""
    return np.concatenate([((hashes * m) >> np.uint64(64 - bits)).astype(np.int64) + (i << bits) for i, m in enumerate(_ROWS)])


class Sketch:
    """One bit for each cell of the merged sketch: whether its count is two or more."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits = bits
        self.of = np.zeros(-(-(len(_ROWS) << bits) // BLOCK) * BLOCK // 8, np.uint8)
        for b, data in blocks.items():
            self.of[b * BLOCK // 8 : (b + 1) * BLOCK // 8] = np.frombuffer(data, np.uint8)

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        c = cells(hashes, self.bits)
        hit = (self.of[c >> 3] >> (c & 7).astype(np.uint8)) & 1
        return hit.reshape(len(_ROWS), -1).all(axis=0)


BLOCK = 1 << 16


def words_of(text: bytes | None) -> list[bytes]:
    """bytes.split() parts words at the same six characters as the pattern."""
    return text.split() if text else []


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(row of the first, words) of some texts at a time. Column 0 is the text."""
    texts, first, n = [], 0, 0
    for i, t in enumerate(batch.column(0).cast(pa.binary())):
        texts.append(words_of(t.as_py()))
        n += len(texts[-1])
        if n >= CHUNK:
            yield first, texts
            texts, first, n = [], i + 1, 0
    if texts:
        yield first, texts


def _sketched(bits: int, width: int, gram: int):
    """Pass 1: the cells that are not zero in a task's sketch, with counts."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        c, n = np.unique(cells(np.concatenate(held), bits), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.minimum(n, 2))], ["cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, held, size = Symbols(), [], 0
        for b in batches:
            for _, texts in _chunks(b):
                held.append(Chunk(texts, symbols, width, gram).anchors())
                size += len(held[-1])
                if size >= HELD:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of a block to its bits."""
    for b in batches:
        data = []
        for found in b.column(1):
            bits = np.zeros(BLOCK, np.uint8)
            bits[found.values.to_numpy()] = 1
            data.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["block", "bits"])


def sketch_of(texts: DataFrame, bits: int, width: int = WIDTH, gram: int = GRAM) -> Sketch:
    """The merged sketch of all windows. texts has the one column text."""
    counted = texts.mapInArrow(_sketched(bits, width, gram), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n >= 2")
    blocks = counted.groupBy(F.expr(f"cell div {BLOCK}").alias("block")).agg(F.collect_list((F.col("cell") % BLOCK).cast("int")).alias("at"))
    return Sketch(bits, {r["block"]: bytes(r["bits"]) for r in blocks.mapInArrow(_blocks, "block long, bits binary").toLocalIterator()})


def _candidates(shared: Broadcast, width: int, gram: int):
    """Pass 2: hashes of the windows estimated repeated, with the place of one; a task's equal windows are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols()
        for b in batches:
            row_keys = b.column(1).to_numpy(zero_copy_only=False)
            for first, texts in _chunks(b):
                c = Chunk(texts, symbols, width, gram)
                at = c.estimated(shared.value)
                if not len(at):
                    continue
                one, two = c.keys(at)
                order = np.lexsort((two, one))
                one, two, at = one[order], two[order], at[order]
                new = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
                n = np.diff(np.append(new, len(one)))
                one, two, at = one[new], two[new], at[new]
                text = np.searchsorted(c.starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(row_keys[first + text]), pa.array(at - c.starts[text]), pa.array(np.minimum(n, 2))], ["one", "two", "key", "at", "n"])

    return run


def _kept(shared: Broadcast, width: int, gram: int):
    """Pass 3: the words that are left, and the spans that go. Columns: text, single (places and hashes), then what goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols()
        for b in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for first, texts in _chunks(b):
                c = Chunk(texts, symbols, width, gram)
                repeated = np.zeros(c.n + 1, bool)
                at = c.estimated(shared.value)
                repeated[at] = True
                hashes = c.keys(at)[0] if len(at) else None
                single = b.column(1).slice(first, len(texts))
                for i, s in enumerate(single):
                    if s.is_valid and len(at):
                        places, wanted = s.values.field(0).to_numpy() + c.starts[i], s.values.field(1).to_numpy()
                        found = np.minimum(np.searchsorted(at, places), len(at) - 1)
                        # a text that only shares its key with the one meant has other windows there
                        repeated[places[(at[found] == places) & (hashes[found] == wanted)]] = False
                edge = np.zeros(c.n + width + 1, np.int64)
                edge[:-width] += repeated
                edge[width:] -= repeated
                gone = np.cumsum(edge)[: c.n] > 0
                # gone words and spans never cross texts: a window lies within its text, but two spans may touch at a border
                step = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
                for i, t in enumerate(texts):
                    s, e = int(c.starts[i]), int(c.starts[i + 1])
                    own = gone[s:e]
                    removed = int(own.sum())
                    n_words.append(e - s)
                    n_removed.append(removed)
                    kept.append(b" ".join(t) if not removed else b" ".join(compress(t, (~own).tolist())))
                    if removed:
                        begins = [0] * bool(own[0]) + [x for x in (np.flatnonzero(step[s:e] == 1)).tolist() if x > 0]
                        ends = [x + 1 for x in np.flatnonzero(step[s + 1 : e] == -1).tolist()] + [e - s] * bool(own[-1])
                        spans.append([{"start": x, "end": y} for x, y in zip(begins, ends)])
                    else:
                        spans.append([])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


def sketch_bits(n_chars: int, width: int = WIDTH, gram: int = GRAM) -> int:
    """Four cells for each expected anchor: a word has about five characters and a blank, an anchor is expected every half span."""
    expected = n_chars / 6 * 2 / (width - gram + 2)
    return min(MAX_BITS, max(16, int(4 * expected).bit_length()))


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (what is left, joined by blanks) and spans (of words that go) of each row."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if bits is None:
        bits = sketch_bits(d.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0], width, gram)
    shared = d.sparkSession.sparkContext.broadcast(sketch_of(d.select("text"), bits, width, gram))
    keyed = d.select("text", F.xxhash64("text").alias("key"), "doc_id")
    candidates = keyed.select("text", "key").mapInArrow(_candidates(shared, width, gram), "one long, two long, key long, at long, n long")
    # Of a window with one place, xor gives that place back; unlike min of a struct it runs as a hash aggregate.
    counted = candidates.groupBy("one", "two").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("at").alias("at"))
    single = cut(counted.filter("n = 1").select("key", "at", "one"))
    of_text = single.groupBy("key").agg(F.collect_list(F.struct("at", "one")).alias("single"))
    if single.count() <= BROADCAST_ROWS:
        met = keyed.join(F.broadcast(of_text), "key", "left")
    else:
        # A text with copies has no window of one place. Rows of the commonest texts, which are few, are dealt by a number of their own and meet nothing.
        counts = keyed.groupBy("key").count()
        common = counts.filter(F.col("count") * COMMON >= docs.count()).filter("count > 1").select("key", F.lit(True).alias("common"))
        spread = keyed.join(F.broadcast(common), "key", "left").withColumn("key", F.when(F.col("common"), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("key")))
        met = spread.join(of_text, "key", "left")
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"
    return met.select("text", "single", "doc_id").mapInArrow(_kept(shared, width, gram), schema)


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

"""Byte-level BPE by recursive DuckDB queries inside each Spark partition.

Words are the matches of the tokenizers' pattern. Each distinct word that a worker has not seen becomes rows (word, position, token), one for each byte. A recursive query joins neighbouring tokens with the merge table, finds each word's pair of least rank, leftmost among equals, and contracts it; words without a pair leave the recursion. A second query aggregates the bytes of a word's tokens in order of position: that is decoding.

The merge table holds every pair of vocabulary entries whose bytes together are an entry, with that entry's rank. A word that is an entry is its own token. The first recursion keeps every step's rows, which grow with the square of a word's length, so words of over LONG bytes take another, one word at a time: it keeps the last token of each position alone, and contracts all places of the least pair at once, from the left. That gives the same ids where an entry's rank is above those of its parts, which is checked; where it isn't, one place is contracted at a time.

Edge cases: a null text counts as empty; an empty text has no ids; memory is bounded by the batch of texts, WORDS words a query and KEPT_WORDS words a worker, and by the length of a text's longest word, not its square; equal rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 200
#: Words and their results that a worker keeps at most; beyond it, it starts anew.
KEPT_WORDS = 700_000
#: Texts that are handled at a time; words and bytes of words that one recursive query takes at most.
TEXTS, WORDS, WORD_BYTES = 500, 40_000, 400_000
MEMORY = "250MB"

#: The tokenizers' pattern, and what its classes are in texts of ASCII, Latin letters and common punctuation, which Python's own regular expressions split several times faster.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _S = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"\t-\r "
COMMON = re.compile(rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")
UNCOMMON = re.compile(rf"[^\x00-\x7f{_L}\xa1\xa7\xab\xb7\xbb\xbf–—‘’“”„…]")

RECURSION = """
WITH RECURSIVE s(done, k, tok) AS (
  SELECT false, k, tok FROM start
  UNION ALL
  (WITH p AS (SELECT k, tok, lead(k) OVER v AS next_k, lead(tok) OVER v AS next_tok FROM s WHERE NOT done WINDOW v AS (ORDER BY k)),
        r AS (SELECT p.k, p.next_k, (m.rank << 20) | (p.k & 1048575) AS z FROM p LEFT JOIN merges m ON m.pair = CASE WHEN p.k >> 20 = p.next_k >> 20 THEN p.tok * 65536 + p.next_tok END),
        best AS (SELECT k >> 20 AS w, min(z) AS z, arg_min(next_k, z) AS gone FROM r GROUP BY 1)
   SELECT best.z IS NULL, s.k, CASE WHEN (s.k & 1048575) = (best.z & 1048575) THEN best.z >> 20 ELSE s.tok END
   FROM s JOIN best ON s.k >> 20 = best.w WHERE NOT s.done AND s.k IS DISTINCT FROM best.gone)
)
SELECT k, tok FROM s WHERE done
"""

#: One word; {places}: which places of the least pair are contracted in a step. Places that follow each other share a token, so every second one of such a run is.
LONG_RECURSION = """
WITH RECURSIVE s(k, tok) USING KEY (k) AS (
  SELECT k, tok FROM start
  UNION ALL
  (WITH p AS (SELECT k, tok, lead(k) OVER v AS next_k, lead(tok) OVER v AS next_tok, row_number() OVER v AS i FROM recurring.s WHERE tok IS NOT NULL WINDOW v AS (ORDER BY k)),
        r AS (SELECT p.k, p.next_k, p.i, m.rank FROM p JOIN merges m ON m.pair = p.tok * 65536 + p.next_tok),
        least AS (SELECT k, next_k, rank, i - row_number() OVER (ORDER BY i) AS run FROM r WHERE rank = (SELECT min(rank) FROM r)),
        chosen AS (SELECT k, next_k, rank FROM least QUALIFY {places})
   SELECT unnest([k, next_k]) AS k, unnest([rank, NULL]) AS tok FROM chosen)
)
SELECT k, tok FROM s WHERE tok IS NOT NULL
"""
ALL_PLACES = "row_number() OVER (PARTITION BY run ORDER BY k) % 2 = 1"
FIRST_PLACE = "row_number() OVER (ORDER BY k) = 1"

DECODE = """
SELECT list(e.tok ORDER BY k) AS ids, string_agg(v.hex, '' ORDER BY k) AS hex
FROM encoded e JOIN vocab v ON v.tok = e.tok GROUP BY k >> {bits} ORDER BY k >> {bits}
"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    pairs, out = [], []
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                pairs.append(left * 65536 + right)
                out.append(rank)
    return pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(out, pa.int64())})


class Coder:
    """Ids and decoded bytes of texts; keeps those of the words that it has seen."""

    def __init__(self, rank_file: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(rank_file)
        if max(self.ranks.values()) >= 65536:
            raise ValueError("ranks of 16 bits are expected")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.pattern = regex.compile(pattern)
        self.common = pattern == PATTERN
        self.ids: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.db.register("m", merge_table(self.ranks))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.register("v", pa.table({"tok": pa.array(list(self.ranks.values()), pa.int64()), "hex": [b.hex() for b in self.ranks]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM v")
        self.db.unregister("m")
        self.db.unregister("v")
        ordered = self.db.execute("SELECT coalesce(bool_and(rank > greatest(pair // 65536, pair % 65536)), true) FROM merges").fetchall()[0][0]
        self.long = LONG_RECURSION.format(places=ALL_PLACES if ordered else FIRST_PLACE)

    def split(self, text: str) -> list[str]:
        if self.common and not UNCOMMON.search(text):
            return COMMON.findall(text)
        return self.pattern.findall(text)

    def _query(self, recursion: str, k: np.ndarray, tok: np.ndarray, bits: int) -> list[tuple[bytes, bytes]]:
        self.db.register("start", pa.table({"k": k, "tok": tok}))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE encoded AS {recursion}")
        out = self.db.sql(DECODE.format(bits=bits)).to_arrow_table()
        self.db.unregister("start")
        ids = out["ids"].combine_chunks()
        flat, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        return [(flat[a:b].tobytes(), bytes.fromhex(h)) for a, b, h in zip(at[:-1], at[1:], out["hex"].to_pylist(), strict=True)]

    def _several(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        lens = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        first = np.cumsum(lens) - lens
        k = (np.repeat(np.arange(len(words), dtype=np.int64), lens) << 20) | (np.arange(len(flat)) - np.repeat(first, lens))
        tok = self.byte[flat]
        # Entries of the vocabulary are one token from the start.
        whole = np.array([self.ranks.get(w, -1) for w in words])
        tok[first[whole >= 0]] = whole[whole >= 0]
        keep = np.repeat(whole < 0, lens)
        keep[first] = True
        return self._query(RECURSION, k[keep], tok[keep], 20)

    def learn(self, words: list[str]) -> None:
        todo, size = [], 0

        def run() -> None:
            for w, (ids, raw) in zip(todo, self._several([w.encode() for w in todo]), strict=True):
                self.ids[w], self.raw[w] = ids, raw

        for w in words:
            b = w.encode()
            if len(b) > LONG and b not in self.ranks:
                flat = np.frombuffer(b, dtype=np.uint8)
                self.ids[w], self.raw[w] = self._query(self.long, np.arange(len(flat), dtype=np.int64), self.byte[flat], 62)[0]
                continue
            todo.append(w)
            size += len(b)
            if len(todo) >= WORDS or size >= WORD_BYTES:
                run()
                todo, size = [], 0
        if todo:
            run()

    def texts(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each."""
        found = [self.split(t) for t in texts]
        if len(self.ids) > KEPT_WORDS:
            self.ids.clear()
            self.raw.clear()
        self.learn([w for w in set(chain.from_iterable(found)) if w not in self.ids])
        for words in found:
            yield b"".join(map(self.ids.__getitem__, words)), b"".join(map(self.raw.__getitem__, words))


_CODERS: dict = {}


def coder(rank_file: bytes, pattern: str) -> Coder:
    """One for each worker process and vocabulary."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _CODERS:
        _CODERS[key] = Coder(rank_file, pattern)
    return _CODERS[key]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. A map over partitions, without a shuffle."""
    with open(rank_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(data.value, pattern)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            # Some texts at a time, so that only so many words are held.
            for at in range(0, len(b), TEXTS):
                n, a, d = [], [], []
                for i, raw in c.texts([t or "" for t in texts[at : at + TEXTS].to_pylist()]):
                    n.append(len(i) // 4)
                    a.append(hashlib.sha256(i).hexdigest())
                    d.append(hashlib.sha256(raw).hexdigest())
                yield pa.RecordBatch.from_arrays([ids[at : at + TEXTS], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

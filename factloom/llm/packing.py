"""Packing of documents into token sequences by first-fit decreasing with a tournament tree.

Documents are dealt into groups at random (by a hash), each packed alone. A document's full sequences are cut off first. What remains of each goes, longest first, into the first open sequence with room for it, which a tournament tree over the sequences' free room finds in logarithmic time. A sequence that stays emptier than SLACK is cut into sequences whose lengths are powers of two, which need no padding.

Ids: those of the `tokenizers` vocabulary file. Texts of common characters without runs of white space go through tiktoken with the same vocabulary, which gives the same ids in a fraction of the time; all others go through `tokenizers` itself.

Edge cases: a null or empty text has the end id only; equal rows are separate documents; a text may fill many sequences; groups are bounded by their bytes in the mean, whatever the keys; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
SLACK = 64
GROUP_BYTES = 6_000_000

#: Unicode's White_Space, which the tokenizers' \s means (Python's \s has four control characters more).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern that both libraries split by, without its look-ahead, which matters only beside runs of white space.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
#: Latin to Cyrillic letters, where both libraries' Unicode tables surely agree, and general punctuation.
UNUSUAL = re.compile(rf"[{WHITE}]{{2}}|[^\x00-ͷЀ-ԯ‐-‧‰-⁞]")


def first_fit_decreasing(sizes: list[int], capacity: int = LENGTH) -> list[int]:
    """The bin of each item. Items are taken in decreasing size, ties in their order; each goes to the first bin with room."""
    n = 1
    while n < max(1, len(sizes)):
        n *= 2
    room = [capacity] * (2 * n)
    where = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s, at = sizes[i], 1
        while at < n:
            at *= 2
            if room[at] < s:
                at += 1
        where[i] = at - n
        room[at] -= s
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return where


def pack(lengths: list[int], capacity: int = LENGTH, slack: int = SLACK) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    pieces, rest, sequence = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((doc, n - n % capacity, n % capacity))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for item, b in zip(rest, first_fit_decreasing([r[2] for r in rest], capacity), strict=True):
        bins.setdefault(b, []).append(item)
    for _, items in sorted(bins.items()):
        total = sum(i[2] for i in items)
        ends = [total]
        if capacity - total > slack:
            ends, left = [], total
            while left:
                left -= 1 << (left.bit_length() - 1)
                ends.append(total - left)
        offset, began, k = 0, 0, 0
        for doc, start, n in items:
            while n:
                take = min(n, ends[k] - offset)
                pieces.append((doc, start, take, sequence + k, offset - began))
                start, n, offset = start + take, n - take, offset + take
                if offset == ends[k]:
                    began, k = offset, k + 1
        sequence += len(ends)
    return pieces


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(vocabulary)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("plain", pat_str=PLAIN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if UNUSUAL.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text), dtype="<u4")


_ENCODERS: dict = {}


def encoder(vocabulary: str) -> Encoder:
    key = hashlib.sha256(vocabulary.encode()).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int = 1, capacity: int = LENGTH) -> DataFrame:
    """One row per piece. sequence_id is the group's number times 2^32 plus the sequence's number in it."""
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))

    def run(t: pa.Table) -> pa.Table:
        encode = encoder(vocabulary.value)
        group = t.column("g")[0].as_py()
        # The order of rows that come from a shuffle is not fixed; this one is.
        order = t.sort_by([("doc_id", "ascending"), ("m", "ascending")])
        ids = order.column("doc_id").to_pylist()
        tokens = [np.append(encode(x or ""), np.uint32(end_id)).astype("<u4") for chunk in order.column("text").chunks for x in chunk.to_pylist()]
        pieces = pack([len(x) for x in tokens], capacity)
        crc = [zlib.crc32(tokens[d][s : s + n].tobytes()) for d, s, n, _, _ in pieces]
        cols = [[ids[p[0]] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], crc, [len(tokens[p[0]]) for p in pieces], [(group << 32) + p[3] for p in pieces], [p[4] for p in pieces]]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("m"))
    dealt = d.withColumn("g", F.pmod(F.xxhash64("doc_id", "m"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, SCHEMA)

"""Order MinHash against a plain version: sketches, likeness, the next document, and filters above the result."""

import random
import re
import time

import pytest
import xxhash
from helpers import DATA, ODD, docs
from pyspark.sql import functions as F

from factloom.llm import order_minhash as M
from factloom.llm.common import table

MASK = (1 << 64) - 1


def longs(*xs):
    """Spark's xxhash64 of longs: each hash is the next one's seed."""
    seed = 42
    for x in xs:
        seed = xxhash.xxh64_intdigest((x & MASK).to_bytes(8, "little"), seed)
    return seed


def text_hash(t):
    return xxhash.xxh64_intdigest(t.encode(), 42)


def tokens(t):
    t = re.sub(f"[{M.NO_BLANKS[1:-1].replace(chr(92) + 'x{20000}', chr(0x20000)).replace(chr(92) + 'x{3FFFF}', chr(0x3FFFF))}]", lambda m: f" {m[0]} ", t)
    words = re.split(r"[ \t-\r]+", re.sub(rf"[^ \t-\r]{{{M.LONG_RUN}}}", lambda m: m[0] + " ", t))
    return [w for w in words if w]


def neighbours(h, k):
    if len(h) >= k:
        return [longs(*h[i : i + k]) for i in range(len(h) - k + 1)]
    return [longs(*h)] if h else []


def occurrence(h, number):
    """Spark's xxhash64 of a long and an int."""
    return xxhash.xxh64_intdigest(number.to_bytes(4, "little"), longs(h))


def sketch(kmers):
    """Codes of (bin, 16 bits of hash, full): k-mers numbered by occurrence, the smallest of each bin, in text order."""
    bits = max(1, next(b for b in range(64) if (1 << b) > len(kmers)))
    met, bins = {}, {}
    for i, h in enumerate(kmers):
        h >>= bits
        k = met[h] = met.get(h, -1) + 1
        numbered = (h if k == 0 else occurrence(h, k - 1) >> bits) << bits
        bins.setdefault(numbered >> (64 - M.BINS_LOG2), []).append((numbered | i, numbered >> bits, i))
    codes = []
    for b, items in bins.items():
        first = sorted(sorted(items)[: M.TUPLE], key=lambda x: x[2])
        codes.append(b * 131072 + (longs(*(x[1] for x in first)) & 0xFFFF) * 2 + (len(first) == M.TUPLE))
    # Spark orders hashes as signed numbers.
    return sorted(codes, key=lambda c: ((c >> 17) + (1 << M.BINS_LOG2 - 1)) % (1 << M.BINS_LOG2))


def fingerprint(t):
    words = sketch(neighbours([text_hash(w) for w in tokens(t)], 2))
    chars = sketch(neighbours([text_hash(c) for c in t], M.CHAR_K)) if 0 < len(t) <= M.SHORT else []
    return words, chars


def one_likeness(a, b):
    filled = len({x >> 17 for x in a} | {x >> 17 for x in b})
    rate = len(set(a) & set(b)) / max(filled, 1)
    mean = 1 + (sum(x & 1 for x in a) + sum(x & 1 for x in b)) / max(len(a) + len(b), 1)
    j = rate ** (1 / mean)
    return 2 * j / (1 + j)


def likeness(x, y):
    if x == y:
        return 1.0
    return one_likeness(x[1], y[1]) if x[1] and y[1] else one_likeness(x[0], y[0])


def shown(x):
    words, chars = (".".join(f"{c:X}" for c in part) for part in x)
    return "-" if not words and not chars else words + (f":{chars}" if chars else "")


def check(rows, got):
    order = sorted(rows, key=lambda r: -r[0])
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(nxt)
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (shown(a), shown(b)), d
        assert got[d].near_edited == pytest.approx(likeness(a, b), abs=1e-6) and got[d].near_next == pytest.approx(likeness(a, c), abs=1e-6)


def test_equals_plain_version(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(10 * i, " ".join(rng.choice(words) for _ in range(rng.randrange(200)))) for i in range(40)]
    rows += [r for r in ODD if r[0] not in (None, 4, 5, 6)] + [(500, "漢字" * 300 + "かな交じり文" * 20), (501, "x" * 3000 + " y"), (502, "a b " * 400)]
    got = {r.doc_id: r for r in M.fingerprints(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    check(rows, got)


def test_long_text_without_blanks_keeps_its_likeness(spark):
    rng = random.Random(2)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(900))
    got = {r.doc_id: r for r in M.fingerprints(docs(spark, [(1, text), (0, "other words " * 200)])).collect()}
    assert got[1].near_edited > 0.4


def test_ranges_keep_the_order(spark, monkeypatch):
    """Many ranges and pieces, one far id, and ids that many rows share: every row is followed by the right one."""
    monkeypatch.setattr(M, "BUCKET_ROWS", 3)
    monkeypatch.setattr(M, "RANGES", 40)
    monkeypatch.setattr(M, "STEP", 4)
    rng = random.Random(3)
    rows = [(i, f"text {i} of many") for i in sorted(rng.sample(range(2000), 300))] + [(10**12, "far away")] + [(700, f"shared id {i}") for i in range(200)] + [(None, f"no id {i}") for i in range(50)] + [(800, "same row")] * 60
    keyed = docs(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = sorted((r.doc_id, r.text, r.next_text) for r in M._with_next(keyed.filter("doc_id is not null"), ["text"]).collect())
    rows = [r for r in rows if r[0] is not None]
    signed = lambda t: text_hash(t) - (1 << 64) if text_hash(t) >> 63 else text_hash(t)
    order = sorted(rows, key=lambda r: (-r[0], -signed(r[1])))
    assert got == sorted((d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order))


def test_odd_and_empty_tables(spark):
    for rows in (ODD, [], [(7, "only one")], [(None, None), (None, None)]):
        assert M.fingerprints(docs(spark, rows)).count() == len(rows)
    clash = docs(spark, ODD).withColumns({c: F.lit("x") for c in ("w", "c", "_k", "_b", "_tie", "fingerprint", "n_chars")})
    assert sorted(map(str, M.fingerprints(clash).collect())) == sorted(map(str, M.fingerprints(docs(spark, ODD)).collect()))


def test_a_filter_costs_no_more(spark):
    d = table(spark, DATA, "documents")
    began = time.perf_counter()
    rows = M.fingerprints(d).collect()
    plain = time.perf_counter() - began
    began = time.perf_counter()
    assert M.fingerprints(d).filter("near_edited < 0.5").count() == sum(r.near_edited < 0.5 for r in rows)
    assert time.perf_counter() - began < 3 * plain + 10

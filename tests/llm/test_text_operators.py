"""Operators on single texts against plain versions, and the cases every operator has to bear."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import DATA, ODD, docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import licences
from factloom.llm.bpe_sql import FIRST_PLACE, LONG_RECURSION, Coder, encode_documents
from factloom.llm.common import table
from factloom.llm.kd_shards import cut, points, shard_documents, split
from factloom.llm.language import UNKNOWN, fit, identify
from factloom.llm.licences import SuffixAutomaton, digest, scan_documents, words_of
from factloom.llm.order_minhash import fingerprints
from factloom.llm.packing import Encoder, first_fit_decreasing, pack, pack_documents
from factloom.llm.quality import quality_rules
from factloom.llm.toxicity import Automaton, quoted, toxicity

EMPTY: list = []


def fuzz(n, seed=0):
    rng = random.Random(seed)
    alphabet = "abc THE'stsll  \n\t.,!?$%09éßñ漢字🙂  ­ا१"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)] + ["x" * 700, "the " * 50, "'s 't don't", "<|endoftext|> a"]


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}


def test_recursive_bpe_equals_tiktoken(ranks):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = Coder(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN)
    texts = fuzz(400)
    for t, (ids, raw) in zip(texts, coder.texts(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == enc.encode_ordinary(t) and raw == t.encode()


def test_long_words_equal_tiktoken(ranks):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data, rng = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), random.Random(9)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ") for _ in range(4000))
    texts = ["x" * 5000, "ab" * 3000 + "a", letters, "漢字" * 700, "=" * 3001, " " * 900 + "x", "thethe" * 200]
    one, c = Coder(data, P.PATTERN), Coder(data, P.PATTERN)
    one.long = LONG_RECURSION.format(places=FIRST_PLACE)
    for t in texts:
        (ids, raw), want = next(c.texts([t])), enc.encode_ordinary(t)
        assert np.frombuffer(ids, dtype="<u4").tolist() == want and raw == t.encode()
    assert next(one.texts([texts[6]])) == next(c.texts([texts[6]]))


def test_plain_split_equals_the_pattern():
    import regex

    c, full = Coder(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN), regex.compile(P.PATTERN)
    assert c.common
    rng = random.Random(10)
    for _ in range(3000):
        t = "".join(rng.choice("aZé ß \n\t\x0b\x1c'strelvmd0123.,-–…«µ²½ª\xa0\x85漢") for _ in range(rng.randrange(25)))
        assert c.split(t) == full.findall(t), t


def test_bpe_documents(spark, ranks):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = sorted(map(str, encode_documents(docs(spark, ODD), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()))
    from pyspark.sql import Row

    def want(d, t):
        ids = enc.encode_ordinary(t or "")
        return Row(doc_id=d, n_tokens=len(ids), ids_sha256=hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), decoded_sha256=hashlib.sha256((t or "").encode()).hexdigest())

    assert rows == sorted(str(want(*r)) for r in ODD)


def test_fast_encoder_equals_tokenizers():
    vocabulary = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    enc, t = Encoder(vocabulary), Tokenizer.from_str(vocabulary)
    t.encode_special_tokens = True
    for x in fuzz(400, 1):
        assert enc(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_first_fit_decreasing():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 2049) for _ in range(200)]
    room, want = [], [0] * 200
    for i in sorted(range(200), key=lambda i: -sizes[i]):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(2048)
        room[b] -= sizes[i]
        want[i] = b
    assert first_fit_decreasing(sizes) == want


@pytest.mark.parametrize("lengths", [[1], [2048], [2049], [5000, 3, 3, 700, 1300], [1] * 3000, []])
def test_pack_is_whole(lengths):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in pack(lengths):
        by_doc[d].append((s, n))
        by_seq[q].append((o, n))
    for ranges in (*by_doc.values(), *by_seq.values()):
        at = 0
        for s, n in sorted(ranges):
            assert s == at and n > 0
            at += n
    assert [sum(n for _, n in by_doc[d]) for d in range(len(lengths))] == lengths
    assert all(sum(n for _, n in x) <= 2048 for x in by_seq.values())


def test_packed_documents(spark):
    rows = pack_documents(docs(spark, ODD), P.path("byte_bpe_50k.json")).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    total = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in ODD)
    assert sum(r.length for r in rows) == total
    one = next(r for r in rows if r.doc_id == 1)
    assert (one.length, one.ids_crc32) == (1, zlib.crc32(np.array([1], dtype="<u4").tobytes()))
    assert pack_documents(docs(spark, EMPTY), P.path("byte_bpe_50k.json")).count() == 0


def test_fingerprints(spark):
    rows = [r for r in ODD if r[0] not in (None, 4)] + [(20, "a long enough text of several words to be edited in its last part by the next one"), (21, "quite another one that shares hardly anything with the text after it, in any order")]
    got = {r.doc_id: r for r in fingerprints(docs(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[5].fingerprint == got[6].fingerprint and got[6].near_next == 1 and got[2].fingerprint == "-"
    assert got[20].near_edited > 0.4 > got[20].near_next
    assert fingerprints(docs(spark, ODD)).count() == len(ODD) and fingerprints(docs(spark, EMPTY)).count() == 0


def test_shards(spark):
    rows = [(i, "t" * (i % 50), "en", f"s{i % 3}") for i in range(400)] + [(1000 + i, "copied text " * 3, "fr", "s0") for i in range(60)]
    got = shard_documents(docs(spark, rows + ODD[:6]), 8).collect()
    assert len(got) == len(rows) + 6
    by, groups = defaultdict(list), defaultdict(set)
    for r in got:
        by[r.shard].append(r)
        groups[r.text_crc32].add(r.shard)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert all(len(g) == 1 for g in groups.values())
    even = [sum(r.size for r in shard_documents(docs(spark, rows[:400]), 4).filter(f"shard = {k}").collect()) for k in range(4)]
    assert max(even) <= 1.6 * min(even)
    assert shard_documents(docs(spark, EMPTY)).count() == 0


def by_shard(rows):
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return sizes


def test_a_heavy_group_takes_a_shard_and_leaves_the_others_even(spark):
    rows = [(i, f"text number {i} " * (1 + i % 7), "en", f"https://one.example/{i % 5}") for i in range(700)]
    third = sum(len(t.encode()) + 1 for _, t, *_ in rows) // 2
    rows += [(5, "copied " * 9, "en", "https://one.example/0")] * (third // 64)
    sizes = by_shard(shard_documents(docs(spark, rows), 8).collect())
    heavy = max(sizes, key=sizes.get)
    others = [n for k, n in sizes.items() if k != heavy]
    assert len(others) == 7 and sizes[heavy] == third // 64 * 64 and max(others) <= 1.1 * min(others)


def test_shards_of_target_bytes(spark):
    rows = [(i, f"{i} " + "abcdefghij " * (1 + i % 13), "en", f"https://{'abc'[i % 3]}.example") for i in range(600)]
    total = sum(len(t) + 1 for _, t, *_ in rows)
    target = 5_000
    sizes = by_shard(shard_documents(docs(spark, rows), target_bytes=target).collect())
    assert sum(sizes.values()) == total and set(sizes) == set(range(len(sizes))) and -(-total // target) == len(sizes)
    assert max(sizes.values()) <= 1.2 * target
    few = by_shard(shard_documents(docs(spark, [*rows[:5], (9, "z" * 20_000)]), target_bytes=10_000).collect())
    assert sorted(few.values()) == [sum(len(t) + 1 for _, t, *_ in rows[:5]), 20_001]


def plain_split(pts, owed, spans, first=0):
    """A plain k-d tree: points in order of their widest dimension, cut where the bytes up to there come nearest to the goal."""
    if owed == 1 or not pts:
        return {p["k"]: first for p in pts}
    dim = max(range(4), key=lambda i: ((max(p["d"][i] for p in pts) - min(p["d"][i] for p in pts)) / max(1, spans[i]), -i))
    pts = sorted(pts, key=lambda p: (p["d"][dim], p["tie"]))
    half = owed // 2
    goal, below = sum(p["w"] for p in pts) * half / owed, 0
    for k, p in enumerate(pts):
        if below + p["w"] > goal:
            break
        below += p["w"]
    k += 0 if goal - below < below + p["w"] - goal else 1
    return plain_split(pts[:k], half, spans, first) | plain_split(pts[k:], owed - half, spans, first + half)


@pytest.mark.parametrize("leaves", [3, 8, 13])
def test_split_against_a_plain_tree(spark, leaves):
    rng = random.Random(leaves)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["https://b", "https://a", "https://abcdefghijk", None])) for i in range(500)]
    pts = cut(points(docs(spark, rows)))
    plain = [{"k": (r.k1, r.k2), "w": r.weight, "d": [r.d0, r.d1, r.d2, r.d3], "tie": r.tie} for r in pts.collect()]
    spans = [max(p["d"][i] for p in plain) - min(p["d"][i] for p in plain) for i in range(4)]
    alone = []
    while (heavy := max(plain, key=lambda p: p["w"]))["w"] * (leaves - len(alone)) > sum(p["w"] for p in plain):
        plain.remove(heavy)
        alone.append(heavy)
    want = plain_split(plain, leaves - len(alone), spans) | {p["k"]: leaves - len(alone) + i for i, p in enumerate(alone)}
    got, n = split(pts, leaves=leaves)
    assert n == leaves and {(r.k1, r.k2): r.shard for r in got.collect()} == want


def test_licence_phrases_and_templates(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "all rights reserved all rights reserved", "x Released under the MIT License. y", "This work is licensed under the GNU General Public License, version 3.", "the general public was under a license", "Licensed under the Apache License, Version 2.0 (the License); you may not, it says, use this file except in compliance with the License. You may obtain a copy", "cc cc by by", None, ""]
    got = {r.doc_id: r for r in digest(scan_documents(docs(spark, list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        at = [k for p in ("cc by", "general public license", "all rights reserved") for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
    assert [got[i].labels for i in range(9)] == ["cc-by,cc-by-nc", "reserved", "mit", "gpl,gpl-3.0", "", "apache-2.0", "cc-by", "", ""]
    assert digest(scan_documents(docs(spark, ODD))).count() == len(ODD)


def test_matching_statistics_against_brute_force():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4)]
    runs = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(6)]
    a = SuffixAutomaton([("x", r) for r in runs], {"w0 w1": "p", "w2 w2 w3": "q"})
    for _ in range(200):
        text = words_of(" ".join(rng.choice([*words, "other"]) for _ in range(30)))
        places, _ = a.scan(text)
        want = sorted((i, label) for phrase, label in (("w0 w1", "p"), ("w2 w2 w3", "q")) for i in range(30) if text[i : i + len(phrase.split())] == words_of(phrase))
        assert sorted(places) == want


def plain_spans(templates, text):
    """The most words of each template that a chain of maximal matches covers: all runs compared, all chains tried."""
    stands = lambda run: any(t[i : i + len(run)] == run for t in templates for i in range(len(t)))
    best = []
    for z in range(1, len(text) + 1):
        a = next(a for a in range(z + 1) if stands(text[a:z]))
        if z - a >= licences.MIN_MATCH and not (z < len(text) and stands(text[a : z + 1])):
            best.append((a, z))
    out = []
    for t in templates:
        anchors = sorted((a, z, ta) for a, z in best for ta in range(len(t)) if t[ta : ta + z - a] == text[a:z])
        covered = []
        for i, (a, z, ta) in enumerate(anchors):
            most = z - a
            for j, (_, pz, pt) in enumerate(anchors[:i]):
                trim = max(0, pz - a, pt + pz - anchors[j][0] - ta)
                if a - pz <= licences.MAX_GAP and trim < z - a and a + trim - pz <= licences.MAX_GAP and ta + trim - (pt + pz - anchors[j][0]) <= licences.MAX_GAP:
                    most = max(most, covered[j] + z - a - trim)
            covered.append(most)
        out.append(max(covered, default=0))
    return out


def test_spans_against_brute_force():
    rng = random.Random(14)
    for _ in range(60):
        runs = [[rng.choice("abcdef") for _ in range(12)] for _ in range(3)]
        a = SuffixAutomaton([(str(i), " ".join(r)) for i, r in enumerate(runs)], {})
        text = []
        for _ in range(3):
            r = list(rng.choice(runs))
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(r))
                r[k : k + rng.randrange(2)] = [rng.choice("abcdefz")]
            text += r + [rng.choice("abcz") for _ in range(rng.randrange(4))]
        most = plain_spans(runs, text)
        got = defaultdict(float)
        for s in a.scan(words_of(" ".join(text)))[1]:
            got[int(s.label)] = max(got[int(s.label)], round(s.cover * 12))
        assert {i: m for i, m in enumerate(most) if m >= licences.MIN_COVER * 12} == dict(got)


def test_repeated_and_inserted_words_keep_one_span():
    words = [f"t{i}" for i in range(20)]
    a = SuffixAutomaton([("x", " ".join(words))], {})
    for text in ([*words[:9], words[7], words[8], *words[9:]], [*words[:5], words[5], words[5], *words[6:]]):
        (s,) = a.scan([w.encode() for w in text])[1]
        assert s.cover == 1 and (s.start, s.end) == (0, len(text))
    grant = words_of(next(t for label, t in licences.TEMPLATES if label == "mit" and t.startswith("Permission")))
    (s,) = [s for s in SuffixAutomaton().scan([*grant[:30], b"software", *grant[30:]])[1] if s.label == "mit"]
    assert s.cover == 1 and (s.start, s.end) == (0, len(grant) + 1)


def test_language(spark):
    made = {"aa": "the and of that with", "bb": "der und die das mit", "cc": "le la et que pour"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(made[lang].split()) for _ in range(30)), lang) for i in range(300) for lang in [("aa", "bb", "cc")[i % 3]]]
    got = {r.doc_id: r for r in identify(docs(spark, [*((*r, "s") for r in rows), (900, None), (901, "123 !?"), (902, ""), (903, "\u00bd \u00b2 \u2167 \u2460")])).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out for r in held) and sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert all((got[i].lang_pred, got[i].score) == (UNKNOWN, 0.0) for i in (900, 901, 902, 903))
    real = table(spark, DATA, "documents").collect()
    m = fit([r.text for r in real], [r.lang for r in real])
    assert (m.weights == 0).mean() > 0.3
    assert identify(docs(spark, ODD)).filter("lang_pred <> 'und'").count() == 0


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    deletes = lambda s: {s[:i] + s[i + 1 :] for i in range(len(s))}
    return b in deletes(a) or a in deletes(b) or any(len(a) == len(b) and a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :] for i in range(len(a)))


def test_levenshtein_automaton_against_brute_force():
    rng = random.Random(6)
    terms = ["abcab", "bbbcc", "aacca", "cab"]
    a = Automaton(terms, ["ccc"])
    for _ in range(4000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8)))
        want = 3 if w.startswith("ccc") else 1 if w in terms else 2 if any(len(t) >= 5 and near(w, t) for t in terms) else 0
        assert a.match(w) == want, w


def test_toxicity(spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "bdfgklmn" for b in ("ara", "olo", "iti", "une", "ebo")]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            for t in rng.sample(["zorgan", "vexxit", "qualmy"], 2):
                w[rng.randrange(60)] = t
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(900, "bara zorgqn dolo vexit " * 3), (901, None), (902, 'he said "zorgan" kune'), (903, "")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(docs(spark, rows), lab).collect()}
    assert sum(got[i].predicted == t for i, _, t in labels) >= 395
    assert got[900].predicted == 1 and got[902].score < got[0].score and got[901].score == got[903].score
    assert toxicity(docs(spark, ODD), lab.filter("false")).filter("score > 0.001").count() == 0
    assert quoted('a "bad" b', 3, 6) and not quoted("a bad b", 2, 5)


def test_quality_counts_against_plain_version(spark):
    rows = [*[r for r in ODD if r[0] not in (None, 4)], (30, "a b c a b c x a b c"), (31, "line one\nline two\nline one\n \n \nline one"), (32, "# $5 |<x>| é&"), (33, "w " * 60), (35, "p q r s p q r x q r s p q " * 5 + "q r"), (34, " ".join(f"v{i}" for i in range(70)))]
    lab = spark.createDataFrame([(34, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(docs(spark, rows), lab).collect()}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(runs)
        repeated = len({k for i, r in enumerate(runs) if often[r] > 1 for k in range(i, i + 3)})
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeated, failed)
    assert got[34].kept and not got[33].kept
    assert quality_rules(docs(spark, EMPTY), lab).count() == 0


def test_quality_under_a_filter(spark):
    d, lab = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    began = time.perf_counter()
    rows = quality_rules(d, lab).collect()
    plain = time.perf_counter() - began
    began = time.perf_counter()
    assert quality_rules(d, lab).filter("kept").count() == sum(r.kept for r in rows)
    assert time.perf_counter() - began < 3 * plain + 10


def test_quality_verdict_on_rows_that_were_not_fitted(spark):
    """Weights from four fifths of the labelled rows, verdicts on the other fifth."""
    d, lab = table(spark, DATA.replace("0.001", "0.01"), "documents"), table(spark, DATA.replace("0.001", "0.01"), "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    got = quality_rules(d, lab.filter(fold != 0)).join(lab.filter(fold == 0), "doc_id").filter("not base_failed").collect()
    assert len(got) > 40 and sum(r.kept == (r.quality == 1) for r in got) >= 0.9 * len(got)

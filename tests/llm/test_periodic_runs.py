import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import DATA, ODD, docs
from test_substring_dedup import words_of

from factloom.llm.periodic_runs import Words, digest, find_runs, frequent, periodic_runs, runs_in
from factloom.llm.queries import repeated_tail


def plain(w, least=6, times=4):
    """(start, length, period) of every run, period by period, by start and period."""
    n, out = len(w), []
    for q in range(1, n // max(2, times) + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(least, times * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(r, most=60):
    n, k = r.randint(0, most), r.choice([1, 2, 3, 5, 8])
    w = [r.randrange(k) for _ in range(n)]
    if n and r.random() < 0.6:
        a = r.randrange(n)
        p = r.randint(1, n - a)
        w = w[:a] + [w[a + i % p] for i in range(n - a)]
    return w


def test_all_squares_against_plain():
    r = random.Random(1)
    for _ in range(1500):
        w = repetitive(r, 40) or [0]
        assert sorted(map(tuple, runs_in(np.array([*w, 99])).tolist())) == sorted(plain(w, 2, 2)), w


def test_texts_share_nothing():
    r = random.Random(2)
    for _ in range(600):
        texts = [repetitive(r) for _ in range(r.randint(1, 4))]
        flat, of = np.array([x for t in texts for x in t], dtype=np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at, want = 0, []
        for t in texts:
            want += [(at + s, n, q) for s, n, q in plain(t)]
            at += len(t)
        assert [tuple(x) for x in find_runs(flat, of).tolist()] == want if len(flat) else not want


def test_cutting_keeps_every_run():
    r = random.Random(3)
    for _ in range(300):
        w = repetitive(r)
        at, _ = frequent(np.array(w, dtype=np.int64), np.zeros(len(w), np.int64)) if w else ([], None)
        assert {i for s, n, _ in plain(w) for i in range(s, s + n)} <= set(np.asarray(at).tolist())


def test_extensions_and_intervals():
    r = random.Random(4)
    for _ in range(60):
        s = [r.randrange(3) for _ in range(r.randint(1, 30))] + [9]
        w = Words(np.array(s))
        assert w.order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        i, j = np.array([(a, b) for a in range(len(s)) for b in range(a + 1, len(s))] or [(0, 0)]).T
        ahead = [next(k for k in range(len(s)) if s[a + k : a + k + 1] != s[b + k : b + k + 1]) if a != b else 0 for a, b in zip(i.tolist(), j.tolist())]
        if i[0] != j[0]:
            assert w.forward(i, j).tolist() == ahead
        depth = np.array([r.randint(1, len(s) - x) for x in range(len(s))])
        low, high = w.interval(np.arange(len(s)), depth)
        for x, d, a, b in zip(range(len(s)), depth.tolist(), low.tolist(), high.tolist()):
            assert sorted(w.order[a : b + 1].tolist()) == [y for y in range(len(s)) if s[y : y + d] == s[x : x + d]]


@pytest.mark.parametrize("words", [[0] * 30_000, [0, 1] * 15_000, list(range(900)) * 20])
def test_long_repetitions_end(words):
    q = len(dict.fromkeys(words))
    assert find_runs(np.array(words), np.zeros(len(words), np.int64)).tolist() == [[0, len(words), q]]


def expected(rows, edit=None):
    out = []
    for i, t in rows:
        w = words_of(t)
        if edit:
            w = [x.decode() for x in edit(i, [x.encode() for x in w])]
        runs = plain(w) if len(set(w)) > 3 or len(w) < 2000 else [(0, len(w), len(set(w)))]
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        out.append((i, len(w), runs, " ".join(x for at, x in enumerate(w) if at not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in df.collect()), key=repr)


def test_odd_rows(spark):
    assert got(periodic_runs(docs(spark, ODD))) == expected(ODD)
    rows = [(1, "a b " * 4), (1, "a b " * 4), (1, "c " * 5), (2, "c " * 6), (None, "x y z\tx\ny z x y z x\x0by\x0cz\r"), (3, "k a a a a a a k b b b b b b b b c")]
    assert got(periodic_runs(docs(spark, rows))) == expected(rows)


def test_empty_and_clashing_columns(spark):
    assert digest(periodic_runs(docs(spark, []))).count() == 0
    df = spark.createDataFrame([(1, "a " * 9, 5, "p"), (2, None, 6, None)], "doc_id int, text string, runs int, collapsed string")
    assert got(periodic_runs(df)) == expected([(1, "a " * 9), (2, None)])


def test_digest_of_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) < 9000")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, _, runs, collapsed in expected(rows, repeated_tail):
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        want.append((i, len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed)))
    assert sorted(map(tuple, digest(periodic_runs(table, repeated_tail)).collect()), key=repr) == sorted(want, key=repr)
    assert any(w[1] for w in want)


def test_repeated_tail():
    words = [b"%d" % i for i in range(50)]
    changed = 0
    for i in range(200):
        h = zlib.crc32(str(i).encode())
        out = repeated_tail(i, words)
        a = h // 10 % 50
        p = 1 + (50 - a) // (3 + h // 10 % 8)
        assert out == (words if h % 10 else [words[x] if x < a else words[a + (x - a) % p] for x in range(50)])
        changed += out != words
    assert changed and repeated_tail(None, words) == words and repeated_tail(5, []) == []

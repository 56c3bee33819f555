import random
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, ODD, docs

from factloom.llm import substring_dedup
from factloom.llm.substring_dedup import Chunk, Symbols, digest, run_hashes, sliding, without_repeats


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def plain(rows, width=35):
    """(doc_id, n_words, n_removed, kept, spans) of each row, window by window."""
    texts = [words_of(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = set()
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] > 1:
                gone.update(range(s, s + width))
        spans = [(s, next(e for e in range(s + 1, len(w) + 1) if e not in gone)) for s in sorted(gone) if s - 1 not in gone]
        out.append((i, len(w), len(gone), " ".join(x for at, x in enumerate(w) if at not in gone), spans))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], [(s["start"], s["end"]) for s in r["spans"]]) for r in df.collect()), key=repr)


def passages(seed=1, n=60):
    r = random.Random(seed)
    shared = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(k)) for k in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(n):
        text = [" ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 40))) for _ in range(4)]
        for _ in range(r.randint(0, 2)):
            text.insert(r.randint(0, 4), r.choice(shared))
        rows.append((i, "\n".join(text)))
    return rows


def test_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    assert got(without_repeats(table)) == plain(rows)
    assert sum(r["n_removed"] for r in digest(without_repeats(table)).collect()) > 0


@pytest.mark.parametrize("bits", [4, 10, 20])
def test_sketches_of_any_size_lose_nothing(spark, bits):
    rows = passages() + [(100, "x " * 40), (101, "y " * 36 + "z"), (102, "p q " * 30)]
    assert got(without_repeats(docs(spark, rows).repartition(5), bits=bits)) == plain(rows)


def test_places_joined(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", -1)
    rows = passages(2) + [(i, "copy " * 50) for i in range(200, 230)]
    assert got(without_repeats(docs(spark, rows), bits=6)) == plain(rows)


def test_small_widths(spark):
    rows = [(i, t) for i, t in enumerate(["a b c d a b c d", "b c d a", "c d", "", "d a b x y z x y z x"])]
    for width, gram in ((3, 2), (4, 4), (2, 1)):
        assert got(without_repeats(docs(spark, rows), width, gram, 8)) == plain(rows, width)


def test_odd_rows(spark):
    assert got(without_repeats(docs(spark, ODD))) == plain(ODD)
    separators = [(1, "\x1c".join("abc") + " \x85    x" + "\x0b\x0c\r".join("uvw"))]
    assert got(without_repeats(docs(spark, separators))) == plain(separators)


def test_empty_and_clashing_columns(spark):
    assert without_repeats(docs(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "a " * 40, 5, 6, 7), (1, "a " * 40, 8, 9, 1), (2, None, 0, 0, 0)], "doc_id long, text string, key int, `at` int, n_words int")
    assert got(without_repeats(df)) == plain([(1, "a " * 40), (1, "a " * 40), (2, None)])


def test_chunks_do_not_change_windows(spark, monkeypatch):
    rows = passages(3)
    expected = plain(rows)
    r = random.Random(9)
    symbols = Symbols()
    texts = [[w.encode() for w in words_of(t)] for _, t in rows]
    whole = Counter(Chunk(texts, symbols, 35, 16).anchors().tolist())
    parts = Counter()
    while texts:
        k = r.randint(1, 9)
        parts.update(Chunk(texts[:k], symbols, 35, 16).anchors().tolist())
        texts = texts[k:]
    assert whole == parts and expected


def test_helpers():
    x = np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)
    for k in (1, 2, 3, 7, 20, 50):
        assert sliding(np.minimum, x, k).tolist() == [min(x[i : i + k].tolist()) for i in range(50 - k + 1)]
    base = 0xD6E8FEB86659FD93
    want = [sum(int(v) * pow(base, j, 1 << 64) for j, v in enumerate(x[i : i + 4])) % (1 << 64) for i in range(47)]
    assert run_hashes(x, base, 4).tolist() == want

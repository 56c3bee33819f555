"""Order MinHash fingerprints, sensitive to edit distance, from DataFrame functions only.

A text's k-mers are its neighbouring pairs of tokens; those that repeat are numbered by occurrence, so a text is a set. Tokens are words, single characters of scripts without blanks, and pieces of very long runs. Their 64-bit hashes fall into BINS equal ranges.
Each bin keeps its TUPLE smallest k-mers, puts them in text order and hashes that tuple. Two texts agree in a bin if they share the smallest k-mers and their order.
Texts of up to SHORT code points also get a second sketch over runs of CHAR_K characters, since a few word pairs tell little.

Likeness: the rate of equal tuples among the bins that are filled in either sketch, taken to the power 1 / (mean tuple size), is an estimate J of the shared part of the union; 2J / (1 + J) is the shared part of the texts. Both sketches of characters are compared where both texts have one, else those of words. Equal fingerprints have likeness 1.

Edge cases: a null text counts as empty; an empty text has the fingerprint "-"; a missing doc_id counts as the least; rows with equal doc_id are ordered by their text's hash, and copies of one row follow each other; a table of one row is its own next document; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import settled

BINS_LOG2 = 6
TUPLE = 2
SHORT = 400
CHAR_K = 4
#: Thai, Lao, Tibetan, Burmese and Khmer letters, kana and Han characters, which are written without blanks; code points of other runs that one token holds at most; a quick test for either.
NO_BLANKS, LONG_RUN = r"[\u0E00-\u109F\u1780-\u17FF\u2E80-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]", 24
UNUSUAL = rf"[\u0E00-\u17FF\u2E80-\x{{10FFFF}}]|(?:\s|^)\S{{{LONG_RUN + 1}}}"
#: Rows that a range of neighbouring ids holds on average in small tables; ranges and their pieces at most; bounds that are passed over at a time.
BUCKET_ROWS, RANGES, PIECES, STEP = 1500, 1024, 256, 32

_EMPTY = "array<bigint>"


def _ushr(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", x, n if isinstance(n, Column) else F.lit(n))


def _none() -> Column:
    return F.array().cast(_EMPTY)


def _sketch(df: DataFrame, kmers: str, out: str) -> DataFrame:
    """Adds out: the sorted tuple codes (bin, 16 bits of hash, whether the tuple is full) of the k-mer hashes in column kmers, which goes."""
    keep = [c for c in df.columns if c != kmers]
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.size(kmers) + F.lit(1.0)))).cast("int")
    df = df.withColumn("_bits", bits).withColumn("_low", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - F.lit(1).cast("long"))
    low, nbits = F.col("_low"), F.col("_bits")
    place = lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i)
    same = lambda x, y: F.coalesce(_ushr(x.bitwiseXOR(y), nbits) == 0, F.lit(False))
    df = df.withColumn("_s", F.sort_array(F.transform(kmers, lambda h, i: place(h, i.cast("long")))))
    s = F.col("_s")
    df = df.withColumn("_again", F.filter(s, lambda x, k: same(x, F.get(s, k - 1))))
    g = F.col("_again")
    # Later occurrences: the first and last of each run, then the numbers within it.
    df = df.withColumns({"_from": F.filter(F.transform(g, lambda x, k: F.when(~same(x, F.get(g, k - 1)), k)), lambda k: k.isNotNull()), "_to": F.filter(F.transform(g, lambda x, k: F.when(~same(x, F.get(g, k + 1)), k)), lambda k: k.isNotNull())})
    runs = F.transform("_from", lambda a, j: F.transform(F.slice(g, a + 1, F.get(F.col("_to"), j) - a + 1), lambda x, o: place(F.xxhash64(_ushr(x, nbits), o), x.bitwiseAND(low))))
    df = df.withColumn("_all", F.when(F.size(g) == 0, s).otherwise(F.sort_array(F.concat(F.array_except(s, g), F.flatten(runs)))))
    a = F.col("_all")
    which = lambda x: _ushr(x, 64 - BINS_LOG2)
    df = df.withColumn("_few", F.filter(a, lambda x, k: F.coalesce(which(x) != which(F.get(a, k - TUPLE)), F.lit(True))))
    few = F.col("_few")

    def code(x: Column, k: Column) -> Column:
        y = F.get(few, k + 1)
        full = F.coalesce(which(y) == which(x), F.lit(False))
        hx, hy = _ushr(x, nbits), _ushr(y, nbits)
        both = F.when(x.bitwiseAND(low) < y.bitwiseAND(low), F.xxhash64(hx, hy)).otherwise(F.xxhash64(hy, hx))
        bits16 = F.when(full, both).otherwise(F.xxhash64(hx)).bitwiseAND(0xFFFF)
        return which(x) * 131072 + bits16 * 2 + full.cast("long")

    codes = F.filter(F.transform(few, lambda x, k: F.when(F.coalesce(which(x) != which(F.get(few, k - 1)), F.lit(True)), code(x, k))), lambda c: c.isNotNull())
    return df.select(*keep, codes.alias(out))


def _tokens(text: Column) -> Column:
    """Words; characters of scripts without blanks stand alone, and other runs are parted every LONG_RUN characters."""
    marked = F.regexp_replace(F.regexp_replace(text, NO_BLANKS, " $0 "), rf"\S{{{LONG_RUN}}}", "$0 ")
    spaced = F.when(text.rlike(UNUSUAL), marked).otherwise(text)
    return F.array_remove(F.split(spaced, r"\s+"), "")


def _neighbours(h: Column, k: int) -> Column:
    """Hashes of each k neighbouring elements, or of all where there are fewer."""
    each = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
    return F.when(F.size(h) >= k, each).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(_none())


def sketches(df: DataFrame, text: str, words: str, chars: str) -> DataFrame:
    """Adds the two sketches of column text (not null)."""
    keep = df.columns
    n = F.length(text)
    letters = F.when((n > 0) & (n <= SHORT), F.transform(F.split(text, ""), lambda x: F.xxhash64(x))).otherwise(_none())
    df = df.withColumns({"_h": F.transform(_tokens(F.col(text)), lambda w: F.xxhash64(w)), "_l": letters})
    df = df.withColumns({"_pairs": _neighbours(F.col("_h"), 2), "_runs": _neighbours(F.col("_l"), CHAR_K)}).drop("_h", "_l")
    return _sketch(_sketch(df, "_pairs", words), "_runs", chars).select(*keep, words, chars)


def as_text(words: str, chars: str) -> Column:
    """The fingerprint: tuple codes in hexadecimal, of words, then of characters."""
    hexed = lambda c: F.array_join(F.transform(c, lambda x: F.hex(x)), ".")
    return F.when((F.size(words) == 0) & (F.size(chars) == 0), F.lit("-")).otherwise(F.concat(hexed(words), F.when(F.size(chars) > 0, F.concat(F.lit(":"), hexed(chars))).otherwise(F.lit(""))))


def _likeness(a: Column, b: Column) -> Column:
    bins = lambda t: F.transform(t, lambda x: _ushr(x, 17))
    full = lambda t: F.size(F.filter(t, lambda x: x.bitwiseAND(1) == 1))
    filled = F.size(F.array_union(bins(a), bins(b)))
    rate = F.size(F.array_intersect(a, b)) / F.greatest(filled, F.lit(1))
    mean = 1 + (full(a) + full(b)) / F.greatest(F.size(a) + F.size(b), F.lit(1))
    j = F.pow(rate, 1 / mean)
    return F.round(2 * j / (1 + j), 6)


def likeness(wa: str, ca: str, wb: str, cb: str) -> Column:
    equal = (F.col(wa) == F.col(wb)) & (F.col(ca) == F.col(cb))
    return F.when(equal, F.lit(1.0)).when((F.size(ca) > 0) & (F.size(cb) > 0), _likeness(F.col(ca), F.col(cb))).otherwise(_likeness(F.col(wa), F.col(wb)))


def _bounds(keyed: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Pairs (_k, _tie) that part the rows into about equal ranges; at most `parts` reach the driver. An id that many rows share is parted by their ties."""
    at = lambda n: [i / n for i in range(1, n)]
    if parts < 2:
        return []
    found = keyed.agg(F.percentile_approx("_k", at(parts), 20 * parts)).first()[0] or []
    times = Counter(found)
    hot = [k for k, n in times.items() if n > 1]
    ties: dict[int, list[int]] = {k: [-(1 << 63)] for k in times}
    if hot:
        for k, t in keyed.filter(F.col("_k").isin(hot)).groupBy("_k").agg(F.percentile_approx("_tie", at(max(times.values()) + 1), 20 * parts)).collect():
            ties[k] += t
    return sorted({(k, t) for k, ts in ties.items() for t in ts})


def _bucket(bounds: list[tuple[int, int]], least: int, most: int, pieces: int) -> Column:
    """The number of the range that (_k, _tie) is in, times pieces, plus the piece of the range's ids in equal widths. Ranges are found among every STEP-th bound, then among the next STEP."""
    k, t = F.col("_k"), F.col("_tie")
    longs = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast(_EMPTY)
    ks, ts = [b[0] for b in bounds], [b[1] for b in bounds]
    if not bounds:
        place = F.lit(0)
    else:
        below = lambda x, y: (x < k) | ((x == k) & (y <= t))
        every = longs(ts[::STEP])
        coarse = F.size(F.filter(longs(ks[::STEP]), lambda x, i: below(x, F.get(every, i))))
        start = F.greatest(coarse - 1, F.lit(0)) * STEP
        fine = F.size(F.filter(F.slice(longs(ks), start + 1, STEP), lambda x, i: below(x, F.get(longs(ts), start + i))))
        place = start + fine
    if pieces == 1:
        return place.cast("long")
    low = F.get(longs([least, *ks]), place).cast("double")
    high = F.get(longs([*ks, most]), place).cast("double")
    piece = F.floor((k.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * pieces)
    return (place.cast("long") * pieces + F.least(F.greatest(piece, F.lit(0)), F.lit(pieces - 1))).cast("long")


def _with_next(df: DataFrame, carried: list[str]) -> DataFrame:
    """Adds next_<c> for each carried column: that of the next row in descending doc_id, after the last that of the first.

    Rows are dealt into ranges of neighbouring ids of about equal size, at most RANGES * PIECES. The first row of each range is sent to the range before it too, where it comes last, so one window over each range has every row's next; the table of these first rows, one for each range, is what is broadcast."""
    least = -(1 << 63)
    keyed = df.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(least)), "_tie": F.xxhash64(carried[0])})
    n, lo, hi = keyed.agg(F.count("*"), F.min("_k"), F.max("_k")).first()
    parts = min(RANGES, max(1, n // BUCKET_ROWS))
    pieces = min(PIECES, max(1, n // (parts * 2 * BUCKET_ROWS)))
    keyed = keyed.withColumn("_b", _bucket(_bounds(keyed, parts), lo or 0, hi or 0, pieces))
    first = keyed.groupBy("_b").agg(F.max(F.struct("_k", "_tie")).alias("_f"))
    order = Window.orderBy("_b")
    lowest = F.first("_b").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = first.select(F.col("_b").alias("_fb"), "_f", F.coalesce(F.lead("_b").over(order), lowest).alias("_to"))
    met = keyed.join(F.broadcast(first), F.col("_b") == F.col("_fb"), "left")
    is_first = (F.col("_k") == F.col("_f._k")) & (F.col("_tie") == F.col("_f._tie"))
    dealt = met.select(*df.columns, "_k", "_tie", F.posexplode(F.when(is_first, F.array("_b", "_to")).otherwise(F.array("_b"))).alias("_again", "_b"))
    w = Window.partitionBy("_b").orderBy("_again", F.desc("_k"), F.desc("_tie"))
    placed = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    return placed.filter("_again = 0").select(*df.columns, *(f"next_{c}" for c in carried))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness, and the likeness to the next document's."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = _with_next(sketches(d, "text", "w", "c"), ["text", "w", "c"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), "w", "c", "next_w", "next_c", edited.alias("edited"))
    return settled(
        sketches(d, "edited", "ew", "ec"),
        ["doc_id", "n_chars"],
        {
            "edited_sha256": F.sha2("edited", 256),
            "fingerprint": as_text("w", "c"),
            "edited_fingerprint": as_text("ew", "ec"),
            "near_edited": likeness("w", "c", "ew", "ec"),
            "near_next": likeness("w", "c", "next_w", "next_c"),
        },
    )

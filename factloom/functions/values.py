"""Numbers, units and currencies out of raw value strings.

The rules are tables: each magnitude has a pattern and, for rupees, dollars and anything else, a factor, a unit and a type. All patterns that can match a row are run once, into columns of their own, before the first that hit decides.
Numbers are rounded to four places, halves away from zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import collapse, contains_any, literal_pattern, missing, or_empty, settled, strip

#: Fixed value: the pattern of a number.
NUMBER = r"([+-]?\s*\d+(?:\.\d+)?)"
VALUE_TYPE = "struct<num:double,unit:string,value_type:string>"

#: Markers of currencies, and magnitudes that a value may come with.
RUPEE, DOLLAR = ("rs", "inr"), ("$", "usd")
MULTIPLIER_WORDS = ("million", "mn", "crore", "cr", "billion", "bn", "lakh", "lac")


@dataclass(frozen=True)
class Reading:
    factor: float
    unit: str
    kind: str
    #: The reading holds only if the cleaned value has one of these.
    words: tuple[str, ...] = ()


@dataclass(frozen=True)
class Magnitude:
    name: str
    suffix: str
    rupee: Reading | None
    dollar: Reading | None
    other: tuple[Reading, ...]
    #: The pattern can match only where one of these stands, in lower case.
    marks: tuple[str, ...]


#: The magnitudes, in the order in which they are tried.
MAGNITUDES = (
    Magnitude("percent", r"(?:%|per\s*cent)", None, None, (Reading(1, "percent", "percentage"),), ("%", "cent")),
    Magnitude("crore", r"cr(?:ore)?s?\b", Reading(1, "INR crore", "currency"), Reading(1, "USD crore", "currency"), (Reading(1, "INR crore", "currency"),), ("cr",)),
    Magnitude(
        "million",
        r"(?:mn|million)s?\b",
        Reading(0.1, "INR crore", "currency"),
        Reading(1, "USD million", "currency"),
        (Reading(1, "million tonnes", "numeric", ("ton",)), Reading(1, "million parcels", "numeric", ("parcel", "shipment")), Reading(1, "million sq ft", "numeric", ("sq ft",)), Reading(1, "million", "numeric")),
        ("mn", "million"),
    ),
    Magnitude("lakh", r"(?:lakh|lac)s?\b", Reading(0.01, "INR crore", "currency"), None, (Reading(1, "lakh", "numeric"),), ("lakh", "lac")),
    Magnitude("billion", r"(?:bn|billion)s?\b", Reading(100, "INR crore", "currency"), Reading(1000, "USD million", "currency"), (Reading(1, "billion", "numeric"),), ("bn", "billion")),
    Magnitude("thousand", r"(?:k|thousand)s?\b", None, None, (Reading(0.001, "million tonnes", "numeric", ("ton",)), Reading(1000, "count", "numeric")), ("k", "thousand")),
)
#: What a number without a magnitude means.
PLAIN = (Reading(1, "INR", "currency"), Reading(1, "USD", "currency"), (Reading(1, "pin_codes", "numeric", ("pin", "code")), Reading(1, "count", "numeric")))


def _scaled(number: Column, factor: float) -> Column:
    """Powers of ten below one divide, so that the result is the nearest double."""
    value = number / F.lit(float(round(1 / factor))) if factor < 1 else number * F.lit(float(factor))
    return F.round(value, 4)


def _value(number: Column | None, unit: str | None, kind: str, factor: float = 1) -> Column:
    n = F.lit(None).cast("double") if number is None else _scaled(number, factor)
    return F.struct(n.alias("num"), F.lit(unit).cast("string").alias("unit"), F.lit(kind).alias("value_type"))


def _read(number: Column, low: Column, rupee: Column, dollar: Column, readings) -> Column:
    inr, usd, other = readings
    out = None
    if inr is not None:
        out = F.when(rupee, _value(number, inr.unit, inr.kind, inr.factor))
    if usd is not None:
        branch = _value(number, usd.unit, usd.kind, usd.factor)
        out = F.when(dollar, branch) if out is None else out.when(dollar, branch)
    for r in other:
        branch = _value(number, r.unit, r.kind, r.factor)
        if r.words:
            test = contains_any(low, r.words)
            out = F.when(test, branch) if out is None else out.when(test, branch)
        else:
            out = branch if out is None else out.otherwise(branch)
    return out


def parse_values(df: DataFrame, raw: str | Column, out: str = "value") -> DataFrame:
    """Adds out: struct(num, unit, value_type) of the raw value; value_type is numeric, currency, percentage, text or unknown."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    keep = df.columns
    clean = F.replace(F.replace(strip(raw), F.lit(","), F.lit("")), F.lit("₹"), F.lit("Rs"))
    # Some documents show the rupee sign as a J before the number.
    broken = clean.rlike(r"^\s*J\s*\d") & clean.rlike(r"(?i)\d\s*(?:mn|million|cr|crore|bn|billion)\b")
    df = df.withColumns({"_raw": raw, "_clean": F.when(broken, F.regexp_replace(clean, r"^\s*J", "Rs")).otherwise(clean)})
    c, low = F.col("_clean"), F.col("_low")
    df = df.withColumn("_low", F.lower(c))
    number = lambda suffix: F.replace(F.nullif(F.regexp_extract(c, rf"(?i){NUMBER}{suffix}", 1), F.lit("")), F.lit(" "), F.lit("")).try_cast("double")
    # A pattern runs only where its marks stand, and the plain number's only where no magnitude hit.
    hits = {f"_{m.name}": F.when(contains_any(low, m.marks), number(r"\s*" + m.suffix)) for m in MAGNITUDES}
    df = df.withColumns(hits | {"_rupee": contains_any(low, RUPEE), "_dollar": contains_any(low, DOLLAR)})
    df = df.withColumn("_plain", F.when(F.coalesce(*(F.col(h) for h in hits)).isNull(), number("")))
    rupee, dollar = F.col("_rupee"), F.col("_dollar")
    result = F.when(missing(F.col("_raw")), _value(None, None, "unknown"))
    for m in MAGNITUDES:
        hit = F.col(f"_{m.name}")
        result = result.when(hit.isNotNull(), _read(hit, low, rupee, dollar, (m.rupee, m.dollar, m.other)))
    sentence = ~rupee & ~dollar & (F.regexp_count(c, F.lit("[a-zA-Z]{2,}")) >= 3)
    result = result.when(sentence, _value(None, None, "text")).when(F.col("_plain").isNotNull(), _read(F.col("_plain"), low, rupee, dollar, PLAIN))
    return settled(df, [k for k in keep if k != out], result.otherwise(_value(None, None, "text")), ("num", "unit", "value_type"), out)


def normalize_values(df: DataFrame, raw: str = "raw_value", unit: str = "raw_unit", quote: str = "evidence_quote", context: str = "source_context", out: str = "value") -> DataFrame:
    """Adds out: struct(num, text, unit, value_type), from a raw value, its separate unit, the quote and the page around it."""
    keep = [c for c in df.columns if c != out]
    r, u = or_empty(F.col(raw)), or_empty(F.col(unit))
    q = or_empty(F.col(quote))
    bare = strip(r)
    # Blanks at its ends matter only where there is no value to look for.
    ctx = F.concat(q, F.lit(" "), or_empty(F.col(context)))
    ctx = F.when(bare == "", strip(ctx)).otherwise(ctx)
    df = df.withColumns({"_r": r, "_u": u, "_q": q, "_bare": bare, "_ctx": ctx, "_alone": strip(F.regexp_replace(u, r"(?i)₹|rs\.?|inr", ""))})
    r, u, q, bare, ctx, alone = (F.col(x) for x in ("_r", "_u", "_q", "_bare", "_ctx", "_alone"))
    joined = strip(F.concat(r, F.lit(" "), u))
    adjacent = (u != "") & bare.rlike(r"^[+-]?\s*\d+(?:\.\d+)?\z") & (alone != "")
    digits = strip(F.replace(F.replace(F.replace(bare, F.lit("₹"), F.lit("")), F.lit("Rs."), F.lit("")), F.lit("Rs"), F.lit("")))
    df = df.withColumns({"_joined": F.when(adjacent, F.concat(r, F.lit(" "), alone)).otherwise(joined), "_digits": digits})
    joined, digits = F.col("_joined"), F.col("_digits")
    # A thousands separator that the page's text layer shows as a decimal point.
    money = contains_any(F.lower(F.concat(u, F.lit(" "), ctx)), ("₹", "rs", "inr"))
    repair = digits.rlike(r"^\d{1,3}\.\d{3}\z") & ctx.rlike(r"\b\d{1,3},\d{3}(?:\.\d+)?\b") & money
    at = F.instr(joined, digits)
    after = F.substring(joined, at + F.length(digits), F.length(joined))
    repaired = F.concat(F.substring(joined, F.lit(1), at - 1), F.replace(digits, F.lit("."), F.lit("")), after)
    df = df.withColumn("_joined", F.when(repair & (at > 0), repaired).otherwise(joined))
    joined = F.col("_joined")
    # A magnitude that stands beside the value in the quote or on the page.
    pattern = F.concat(F.lit("(?i)(?:"), literal_pattern(bare), F.lit("|"), literal_pattern(F.replace(bare, F.lit(","), F.lit(""))), F.lit(r")\s*(?:mn|million|cr|crore|bn|billion|lakh|lac|k)\b"))
    # What has no letters is the same in either case, so a plain search tells whether the pattern has anything to match.
    there = bare.rlike("[A-Za-z]") | F.contains(ctx, bare) | F.contains(ctx, F.replace(bare, F.lit(","), F.lit("")))
    lacking = (q != "") & ~contains_any(F.lower(joined), MULTIPLIER_WORDS) & there
    df = df.withColumn("_near", F.when(lacking, F.call_function("regexp_extract", ctx, pattern, F.lit(0))).otherwise(F.lit("")))
    prefix = F.when(contains_any(F.lower(ctx), ("rs", "₹", "inr", "$", "usd")), F.lit("Rs ")).otherwise(F.lit(""))
    df = df.withColumn("_joined", F.when(F.col("_near") != "", F.concat(prefix, F.col("_near"))).otherwise(joined))
    df = parse_values(df, "_joined", "_parsed")
    p = F.col("_parsed")
    no_text = F.lit(None).cast("string").alias("text")
    number = F.struct(p["num"].alias("num"), no_text, p["unit"].alias("unit"), p["value_type"].alias("value_type"))
    text = F.struct(F.lit(None).cast("double").alias("num"), strip(collapse(F.col("_r"))).alias("text"), F.coalesce(F.nullif(F.col("_u"), F.lit("")), F.lit("text")).alias("unit"), F.lit("text").alias("value_type"))
    return settled(df, keep, F.when(p["num"].isNotNull(), number).otherwise(text), ("num", "text", "unit", "value_type"), out)

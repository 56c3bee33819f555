"""String helpers whose white space is Unicode's."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def missing(c: Column) -> Column:
    """Null or empty, as an optional text counts as absent."""
    return F.coalesce(c == "", F.lit(True))


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def settled(df: DataFrame, keep: list[str], result: Column, fields: tuple[str, ...], out: str) -> DataFrame:
    """The columns in keep, and out: the struct result with these fields, made by a generator. Filters on it stay above it, so that a costly result is computed once a row and not again inside each of them. A null result gives null fields."""
    names = [f"_settled_{f}" for f in fields]
    made = df.select(*keep, F.inline(F.array(result)).alias(*names))
    return made.select(*keep, F.struct(*(F.col(n).alias(f) for n, f in zip(names, fields, strict=True))).alias(out))


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c computed once, however often body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def literal_pattern(c: Column) -> Column:
    r"""A pattern that matches the text c itself."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))

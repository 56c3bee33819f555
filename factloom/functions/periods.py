"""Reporting periods, given as free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import collapse, contains_any, let, missing, or_empty, strip

#: Fiscal years written as two, and the year in which each ends.
FISCAL_SPANS = (("2023-24", "2024"), ("2023–24", "2024"), ("2022-23", "2023"), ("2021-22", "2022"))
#: Names of the end of fiscal year 2024; the shortest is part of each.
END_OF_2024 = ("march 31, 2024", "as of march 31, 2024", "q4 2024", "2024", "end of q4 2024")


def normalize_period(c: Column) -> Column:
    t = strip(F.lower(or_empty(c)))
    for word in ("fy", "fiscal"):
        t = F.regexp_replace(t, rf"\b{word}\s*(\d{{2}})\b", "20$1")
    for span, year in FISCAL_SPANS:
        t = F.replace(t, F.lit(span), F.lit(year))
    return collapse(t)


def compare_periods(a: Column, b: Column) -> Column:
    """struct(same, reason)."""
    return let(F.struct(a.alias("a"), b.alias("b"), normalize_period(a).alias("na"), normalize_period(b).alias("nb")), _compared)


#: The reasons, whose wordings the given results compare.
def _compared(p: Column) -> Column:
    a, b, na, nb = (p.getField(x) for x in ("a", "b", "na", "nb"))
    ya, yb = (F.nullif(F.regexp_extract(n, r"\b(20\d\d)\b", 1), F.lit("")) for n in (na, nb))
    said = lambda same, *reason: F.struct(F.lit(same).alias("same"), F.concat(*(F.lit(r) if isinstance(r, str) else r for r in reason)).alias("reason"))
    return (
        F.when(missing(a) | missing(b), said(True, "One or both facts lack explicit temporal context"))
        .when(na == nb, said(True, "Identical reporting period (", a, ")"))
        .when(contains_any(na, END_OF_2024) & contains_any(nb, END_OF_2024), said(True, "Compatible reporting period (FY24 / March 31, 2024)"))
        .when(ya != yb, said(False, "Different reporting periods / years (", ya, " in '", a, "' vs ", yb, " in '", b, "')"))
        .otherwise(said(True, "Temporally compatible"))
    )

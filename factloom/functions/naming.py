"""Keys by which facts of different documents are about the same thing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import contains_any, let

#: Clusters of predicates in order; a predicate belongs to the first of which it has a part from each group.
CLUSTERS = (
    ("revenue", (("revenue", "turnover", "sales_income", "gross_receipts", "topline"),)),
    ("profitability", (("ebitda", "operating_profit", "net_profit", "net_income"),)),
    ("pin_codes", (("pin",), ("code", "reach", "cover"))),
    ("workforce", (("workforce", "team_size", "headcount", "employee_strength", "staff_count"),)),
    ("active_customers", (("customer",), ("active", "count", "base", "total"))),
    ("registered_office", (("registered",), ("office", "address"))),
    ("corporate_office", (("corporate", "headquarter", "hq"), ("office", "address"))),
    ("office_address", (("address", "office"),)),
    ("governance_directorship", (("director", "board_member", "directorship", "trustee"),)),
    ("gdp_growth", (("gdp",), ("growth", "rate", "projection", "real"))),
    ("inflation", (("inflation", "cpi", "wpi", "deflator"),)),
)
VOLUME = ("volume", "shipment", "tonnage", "freight")
VOLUME_FILLERS = ("count", "number", "total", "annual", "quarterly")
#: Words of company names that tell nothing.
COMPANY_WORDS = ("limited", "ltd", "corporation", "inc", "private", "pvt", "the")


def clean_predicate(c: Column) -> Column:
    # Of small letters \W is [^a-z0-9_], and several times as fast.
    return F.regexp_replace(F.replace(F.replace(F.lower(c), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_")), r"\W+", "")


def predicate_cluster(c: Column) -> Column:
    return let(clean_predicate(c), _cluster)


def _cluster(p: Column) -> Column:
    out = None
    for name, groups in CLUSTERS:
        test = reduce(lambda a, b: a & b, (contains_any(p, g) for g in groups))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    tokens = F.filter(F.split(p, "_"), lambda t: ~t.isin(*VOLUME_FILLERS))
    return out.when(contains_any(p, VOLUME) & (F.size(tokens) >= 2), F.array_join(F.slice(tokens, 1, 2), "_")).otherwise(p)


def subject_key(c: Column) -> Column:
    words = "|".join(COMPANY_WORDS)
    return F.regexp_replace(F.regexp_replace(F.lower(c), rf"\b(?:{words})\b", ""), "[^a-z0-9]+", "")


def comparison_key(subject: Column, predicate: Column) -> Column:
    return F.concat(subject_key(subject), F.lit("|"), predicate_cluster(predicate))

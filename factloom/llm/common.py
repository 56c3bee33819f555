"""Shared helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.shared import made_once
from factloom.plans.pipeline import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there: cuts the lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_small(df: DataFrame, rows: int = 100_000) -> tuple[DataFrame, int]:
    """As made_once(), with the number of rows; no more partitions are left than rows need, so that small tables don't make many tiny shuffle files."""
    c = made_once(df)
    n = c.count()
    return c.coalesce(n // rows + 1), n


def double_array(values) -> Column:
    """A constant array of doubles. It is given as one string that the optimizer folds once, so that the plan holds no expression per value."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def settled(df: DataFrame, keep: list[str], results: dict[str, Column]) -> DataFrame:
    """The columns in keep and the results, which a generator makes: filters on them stay above it, so that costly expressions are not computed again inside each filter."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in results.items())))))

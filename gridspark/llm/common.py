"""Helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.plans.scratch import small, written  # noqa: F401

#: White space that separates words: space and U+0009 to U+000D, as a Java character class body.
BLANKS = r"\x20\x09-\x0D"
#: The same characters, for trim and translate.
BLANK_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    r"""Array of the words [^\x20\x09-\x0D]+ of a text; empty for null or blank text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+"))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANKS}]+")).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body uses it in nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)

"""Cleaning of free labels with vocabularies that the caller gives as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_terms(df: DataFrame, column: str, vocabulary: DataFrame, out: str, otherwise: str | None = None) -> DataFrame:
    """``df`` with ``out``: the group of the lower-cased term, else ``otherwise`` (null by default).

    ``vocabulary``: (term, group). Terms are compared in lower case and not trimmed; of terms that repeat the least group counts.
    """
    groups = vocabulary.select(F.lower("term").alias("_term"), F.col("group").alias("_group")).groupBy("_term").agg(F.min("_group").alias("_group"))
    joined = df.join(groups, F.lower(F.col(column)) == F.col("_term"), "left")
    return joined.withColumn(out, F.coalesce("_group", F.lit(otherwise))).drop("_term", "_group")


def harmonised(column: Column, replacements: list[tuple[str, str]]) -> Column:
    """Literal substring replacements, in their order."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), replacements, column)


def has_keyword(column: str, keywords: list[str]) -> Column:
    """Whether any keyword is a substring, in its own case; null counts as no."""
    return F.coalesce(reduce(lambda a, b: a | b, (F.col(column).contains(k) for k in keywords)), F.lit(False))


def without_quotes(column: str) -> Column:
    return F.translate(F.col(column), "'\"", "")

"""Columns that the optimizer doesn't write out again wherever they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a one-row generator. Filters on them stay above it, so that a long CASE is
    evaluated once, not copied into every expression and predicate that refers to it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def decided(df: DataFrame, verdict: Column) -> DataFrame:
    """Adds the fields of a struct column the same way; rows where it is null go."""
    return df.select("*", F.inline(F.filter(F.array(verdict), lambda x: x.isNotNull())))

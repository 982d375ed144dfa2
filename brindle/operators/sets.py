"""Algebra on sets of documents.  Within one collection prefer predicates (&, |, & ~): they
need no shuffle.  These work across frames, keyed by one column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def intersection(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, sets)


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, sets).distinct()


def difference(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(DataFrame.subtract, others, first)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not among ids."""
    return df.join(ids.select(key).distinct(), key, "left_anti")

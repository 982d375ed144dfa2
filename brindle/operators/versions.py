"""Latest versions, changes, deletion and expiry of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, *version: Column) -> DataFrame:
    """Of each key the row with the greatest version.

    A grouped maximum of (version, row): rows are aggregated before the shuffle, so a key with very
    many versions does not gather in one task as it would under a window."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(key).agg(F.max_by(row, F.struct(*version)).alias("_row"))
    return best.select("_row.*")


def changed_fields(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, changed: the columns whose value differs (null is a value); keys without change or
    without an old row are left out."""
    joined = new.alias("n").join(old.alias("o"), key)
    differs = [
        F.when(~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")), F.lit(c)) for c in columns
    ]
    changed = F.array_compact(F.array(*differs))
    return joined.select(key, changed.alias("changed")).where(F.size("changed") > 0)


def unexpired(df: DataFrame, column: str, now) -> DataFrame:
    """Rows that have not expired at `now`; rows without an expiry never do."""
    return df.where(F.col(column).isNull() | (F.col(column) > F.lit(now)))

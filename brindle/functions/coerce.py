"""Coercion of raw values to field types."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_MOST = 65536


def present(value: Column, kind: T.DataType) -> Column:
    """The value, with an empty string counted as missing."""
    return F.nullif(value, F.lit("")) if isinstance(kind, T.StringType) else value


def number(value: Column, kind: T.DataType) -> Column:
    """A double; of a string the leading number, null if there is none."""
    if isinstance(kind, T.StringType):
        lead = F.regexp_extract(value, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
        return F.nullif(lead, F.lit("")).try_cast("double")
    return value.cast("double")


def integer(value: Column, kind: T.DataType) -> Column:
    """A long; of a string the leading integer, of a fraction its whole part."""
    if isinstance(kind, T.StringType):
        return F.nullif(F.regexp_extract(value, r"^\s*([-+]?\d+)", 1), F.lit("")).try_cast("long")
    return value.cast("long")


def small(value: Column, kind: T.DataType) -> Column:
    whole = integer(value, kind)
    return F.when(whole > SMALL_MOST, SMALL_MOST).otherwise(whole).cast("int")


def seconds(value: Column, kind: T.DataType) -> Column:
    """Whole seconds since 1970 UTC; strings are ISO-8601, UTC where they name no zone."""
    if isinstance(kind, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value)
        return F.floor(micros / 1_000_000).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(value)
    if isinstance(kind, T.DateType):
        return (F.unix_date(value) * 86400).cast("long")
    if isinstance(kind, T.StringType):
        zoned = value.rlike(r"(Z|[+-]\d\d:?\d\d)\s*$")
        stamp = F.when(zoned, value).otherwise(F.concat(value, F.lit("Z")))
        day = F.when(value.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(value, F.lit("T00:00:00Z"))).otherwise(stamp)
        return F.unix_seconds(day.try_cast("timestamp"))
    return value.cast("long")


def truth(value: Column, kind: T.DataType) -> Column:
    """True for all but null, false, zero, not-a-number and the empty string."""
    if isinstance(kind, T.BooleanType):
        test = value
    elif isinstance(kind, T.StringType):
        test = value != ""
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        test = (value != 0) & ~F.isnan(value)
    elif isinstance(kind, T.NumericType):
        test = value != 0
    else:
        test = value.isNotNull()
    return F.coalesce(test, F.lit(False))


def variant_truth(variant: Column) -> Column:
    """`truth` of a JSON value."""
    kind = F.schema_of_variant(variant)
    text = F.try_variant_get(variant, "$", "string")
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(variant, "$", "boolean"))
        .when(kind == "STRING", text != "")
        .when(kind == "VOID", F.lit(False))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(True))
        .otherwise(F.try_variant_get(variant, "$", "double") != 0),
        F.lit(False),
    )


def constant_seconds(value) -> int | None:
    """Seconds of a query constant."""
    if value is None or isinstance(value, (int, float)):
        return None if value is None else int(value)
    if isinstance(value, datetime):
        at = value
    else:
        at = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() // 1)

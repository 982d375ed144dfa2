"""From raw documents to typed columns: coercions, defaults, derived fields and shadow columns.

For a field f the indexed frame has f (typed; geo: struct lat, lon; text: the string), and
f__norm (literal: normalised string or strings) or f__tokens (text: array of words).  Shadow
columns are plain columns, so written out once they are pruned and filtered by the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce, text
from .namespace import FieldDef, Namespace

COERCE: dict[str, Callable[[Column, T.DataType], Column]] = {
    "number": coerce.number,
    "integer": coerce.integer,
    "smallinteger": coerce.small,
    "date": coerce.seconds,
    "boolean": coerce.truth,
}
RAW_TYPES = {
    "literal": "string",
    "text": "string",
    "number": "string",
    "integer": "string",
    "smallinteger": "string",
    "date": "string",
    "geo": "array<double>",
}


def norm(name: str) -> str:
    return f"{name}__norm"


def words(name: str) -> str:
    return f"{name}__tokens"


def read_json(raw: DataFrame, ns: Namespace, column: str = "value") -> DataFrame:
    """Documents as JSON strings -> _raw, id and the declared fields, untyped but for booleans.

    A scalar in an array field becomes an array of one; an array in a scalar field keeps its
    elements as an array of one-element semantics (any element matches)."""
    rows = raw.select(F.col(column).alias("_raw"), F.try_parse_json(F.col(column)).alias("_v"))
    out = [F.col("_raw"), F.try_variant_get("_v", "$.id", "string").alias("id")]
    for f in ns.fields.values():
        if f.name == "id":
            continue
        # a derived boolean is the truth of the source as it stands in the document
        at = f"$['{f.sources[0] if f.type == 'boolean' and f.sources else f.name}']"
        part = F.try_variant_get("_v", at, "variant")
        if f.type == "boolean":
            there = F.schema_of_variant(part) != "VOID"
            out.append(F.when(there, coerce.variant_truth(part)).alias(f.name))
        elif f.type == "geo":
            pair = F.try_variant_get("_v", at, "array<double>")
            out.append(F.struct(F.get(pair, 0).alias("lat"), F.get(pair, 1).alias("lon")).alias(f.name))
        elif f.array:
            one = F.try_variant_get("_v", at, "string")
            many = F.try_variant_get("_v", at, "array<string>")
            out.append(F.coalesce(many, F.when(one.isNotNull(), F.array(one))).alias(f.name))
        else:
            out.append(F.try_variant_get("_v", at, "string").alias(f.name))
    return rows.select(*out)


def _default(f: FieldDef, kind: T.DataType) -> Column | None:
    if f.default is None:
        return None
    if isinstance(kind, T.ArrayType):
        values = f.default if isinstance(f.default, (list, tuple)) else [f.default]
        return F.array(*[F.lit(v).cast(kind.elementType) for v in values])
    return F.lit(f.default).cast(kind)


def with_defaults(df: DataFrame, ns: Namespace) -> DataFrame:
    """Missing values (null or the empty string) replaced by the declared default, derived single-source
    fields filled from their source; an empty text without a default stays, it has no words; the stored
    JSON is untouched."""
    for f in ns.fields.values():
        if f.type == "text" and f.sources:
            continue
        told = f.type == "boolean" and isinstance(df.schema[f.name].dataType if f.name in df.columns else None, T.BooleanType)
        source = f.sources[0] if f.sources and not told else f.name
        if source not in df.columns:
            kind = T.BooleanType() if f.type == "boolean" else T.StringType()
            value = F.lit(None).cast(kind)
        else:
            kind = df.schema[source].dataType
            value = F.col(source) if f.type == "text" and f.default is None else coerce.present(F.col(source), kind)
        if f.type == "boolean" and not isinstance(kind, T.BooleanType):
            value, kind = F.when(value.isNotNull(), coerce.truth(value, kind)), T.BooleanType()
        own = _default(f, kind)
        if f.type == "boolean":
            value = F.coalesce(value, F.lit(bool(f.default)))
        elif own is not None:
            value = F.coalesce(value, own)
        df = df.withColumn(f.name, value)
    return df


def indexed(df: DataFrame, ns: Namespace) -> DataFrame:
    """Typed and shadow columns of every declared, indexed field."""
    df = with_defaults(df, ns)
    made: dict[str, Column] = {}
    for f in ns.fields.values():
        if f.type == "text":
            made |= _text(df, f)
            continue
        kind = df.schema[f.name].dataType
        if f.type == "literal":
            if isinstance(kind, T.ArrayType):
                value = F.transform(F.col(f.name), lambda x: x.cast("string"))
                made[f.name] = value
                shadow = F.transform(F.filter(value, lambda x: x.isNotNull() & (x != "")), lambda x: text.normalised(x))
            else:
                value = F.col(f.name).cast("string")
                made[f.name] = value
                shadow = text.normalised(value)
            if f.index:
                made[norm(f.name)] = _stemmed(shadow, f, isinstance(kind, T.ArrayType))
        elif f.type in COERCE and isinstance(kind, T.ArrayType):
            made[f.name] = F.transform(F.col(f.name), lambda x: COERCE[f.type](x, kind.elementType))
        elif f.type in COERCE:
            made[f.name] = COERCE[f.type](F.col(f.name), kind)
        elif f.type == "geo" and not isinstance(kind, T.StructType):
            made[f.name] = F.struct(F.get(f.name, 0).cast("double").alias("lat"), F.get(f.name, 1).cast("double").alias("lon"))
    return df.withColumns(made)


def _stemmed(shadow: Column, f: FieldDef, many: bool) -> Column:
    if not f.stem:
        return shadow
    return text.stems(shadow, f.lang) if many else F.get(text.stems(F.array(shadow), f.lang), 0)


def _text(df: DataFrame, f: FieldDef) -> dict[str, Column]:
    """A text field: its own value, or its sources' words one after another."""
    stop = text.stop_words(f.lang) if f.stop else ()
    parts = []
    for s in f.sources or (f.name,):
        if s not in df.columns:
            continue
        kind = df.schema[s].dataType
        value = F.array_join(F.col(s).cast("array<string>"), " ") if isinstance(kind, T.ArrayType) else F.col(s).cast("string")
        parts.append(value)
    if not parts:
        parts = [F.lit(None).cast("string")]
    if len(parts) > 1:
        whole = F.nullif(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))
    else:
        whole = parts[0]
    found = text.tokens(whole, stop, f.separators)
    return {f.name: whole, words(f.name): text.stems(found, f.lang) if f.stem else found}

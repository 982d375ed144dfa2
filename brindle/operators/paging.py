"""Sorting, paging and computed distance columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.indexing import norm
from ..sources.namespace import Namespace, SchemaError

SEQ = "_seq"


def distance_column(ns: Namespace, told: Mapping) -> Column | None:
    """{type: distance, field, from, unit}; other types produce nothing."""
    if told.get("type") != "distance":
        return None
    f = ns.declared(told["field"])
    if f.type != "geo":
        raise SchemaError(f"field {f.name} is no geo field")
    unit = told.get("unit", "m")
    if unit not in geo.OUTPUT_UNITS:
        raise SchemaError(f"unknown unit {unit}")
    far = geo.distance(F.col(f"{f.name}.lat"), F.col(f"{f.name}.lon"), tuple(map(float, told["from"])))
    return far * F.lit(geo.OUTPUT_UNITS[unit])


def expressions(ns: Namespace, told: Mapping[str, Mapping] | None) -> dict[str, Column]:
    made = {n: distance_column(ns, x) for n, x in (told or {}).items()}
    return {n: c for n, c in made.items() if c is not None}


def sort_keys(ns: Namespace, told: Sequence[Mapping] | None, exprs: Mapping[str, Column]) -> list[Column]:
    """Keys of the request, missing values least, and at last the order of insertion."""
    keys = []
    for spec in told or ():
        order = str(spec.get("order", "ASC")).upper()
        if order not in ("ASC", "DESC"):
            raise SchemaError(f"unknown order {order}")
        name = spec["field"]
        if name in exprs:
            column = exprs[name]
        else:
            f = ns.declared(name)
            if not f.sort:
                raise SchemaError(f"field {name} is not sortable")
            column = F.col(norm(name) if f.type == "literal" else name)
            if f.array:
                column = F.try_element_at(column, F.lit(-1))
        keys.append(column.asc_nulls_first() if order == "ASC" else column.desc_nulls_last())
    return [*keys, F.col(SEQ).asc()]


def page(df: DataFrame, keys: Sequence[Column], start: int = 0, count: int = 10) -> DataFrame:
    """One page: Spark keeps start + count rows of each task (no whole sort)."""
    ordered = df.orderBy(*keys)
    return (ordered.offset(start) if start else ordered).limit(count)

"""Value and range facets of a match set, each kind in one pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.namespace import Namespace, SchemaError
from .predicates import between

COUNT = 10


def facetable(ns: Namespace, name: str):
    f = ns.declared(name)
    if not f.facet:
        raise SchemaError(f"field {name} is no facet")
    return f


def _entry(name: str, text: bool):
    """A value of a facet: literals as text, all others as a number."""

    def make(value):
        return F.struct(
            F.lit(name).alias("facet"),
            (value if text else F.lit(None)).cast("string").alias("text"),
            (F.lit(None) if text else value).cast("double").alias("number"),
        )

    return make


def value_facets(df: DataFrame, ns: Namespace, told: Mapping[str, Mapping]) -> DataFrame:
    """facet, rank, text, number, count: of each facet the first values by count, then value.

    Rows are melted once to (facet, value), counted with partial aggregation, and ranked; ranking
    keeps `count` rows a facet in each task before it shuffles."""
    parts, orders, limits = [], {}, {}
    for name, spec in told.items():
        f = facetable(ns, spec["field"])
        order = str(spec.get("order", "ASC")).upper()
        if order not in ("ASC", "DESC"):
            raise SchemaError(f"facet {name}: unknown order {order}")
        orders[name], limits[name] = order, int(spec.get("count", COUNT))
        entry = _entry(name, f.type == "literal")
        none = F.array().cast("array<struct<facet:string,text:string,number:double>>")
        parts.append(F.coalesce(F.transform(f.name, entry), none) if f.array else F.array(entry(F.col(f.name))))
    melted = df.select(F.explode(F.concat(*parts)).alias("e")).select("e.*")
    counts = (
        melted.where("(text is not null and text <> '') or number is not null")
        .groupBy("facet", "text", "number")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # one window for both directions: a facet's rows all go one way, so each key that sorts upwards
    # has a twin that sorts downwards, and one of the two is null throughout
    down = F.col("facet").isin(*[n for n, o in orders.items() if o == "DESC"] or [""])
    sign = F.when(down, -1).otherwise(1)
    keys = [sign * F.col("count")]
    for key in (F.lower("text"), F.col("text")):
        keys += [F.when(~down, key).asc(), F.when(down, key).desc()]
    top = Window.partitionBy("facet").orderBy(*keys, sign * F.col("number"))
    ranked = counts.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= max(limits.values()))
    cut = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return ranked.where(F.col("rank") <= cut[F.col("facet")]).select("facet", "rank", "text", "number", "count")


def bucket_label(bucket: Mapping) -> str:
    low = "(" if bucket.get("minExcl") else "["
    high = "(" if bucket.get("maxExcl") else "["
    show = lambda v: "" if v is None else str(v)
    return bucket.get("label") or f"{low}{show(bucket.get('min'))},{high}{show(bucket.get('max'))}"


def bucket_facets(df: DataFrame, ns: Namespace, told: Mapping[str, Mapping]) -> DataFrame:
    """facet, rank, text (the label), count of every bucket that has documents; one pass over df.
    A document counts once in a bucket, whichever of its values falls there."""
    sums, names = [], []
    for name, spec in told.items():
        for i, bucket in enumerate(spec["buckets"]):
            f = facetable(ns, bucket["field"])
            test = between(f, bucket)
            if test is None:
                hit = F.size(f.name) > 0 if f.array else F.col(f.name).isNotNull()
            else:
                hit = F.exists(f.name, test) if f.array else test(F.col(f.name))
            names.append((name, i + 1, bucket_label(bucket)))
            sums.append(F.count_if(hit).alias(f"b{len(sums)}"))
    totals = df.agg(*sums)
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("facet"), F.lit(i).alias("rank"), F.lit(label).alias("text"), F.col(f"b{k}").alias("count"))
            for k, (n, i, label) in enumerate(names)
        ]
    )
    return totals.select(F.inline(rows)).where("count > 0")


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many different values each column has: the cardinality of an index."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])

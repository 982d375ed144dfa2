"""A search request against an indexed collection: total, page, facets, expressions."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import facets, paging
from ..sources.namespace import Namespace
from .request import where


@dataclass
class Search:
    """The plan of a request: each part is a lazy frame over the same filtered one."""

    ns: Namespace
    matches: DataFrame
    request: Mapping

    @classmethod
    def plan(cls, docs: DataFrame, ns: Namespace, request: Mapping) -> Search:
        test = where(ns, request.get("query"), request.get("lang"))
        return cls(ns, docs if test is None else docs.where(test), request)

    def total(self) -> DataFrame:
        return self.matches.agg(F.count(F.lit(1)).alias("total_found"))

    def page(self) -> DataFrame | None:
        """The page's rows with the expressions as columns; None for count 0."""
        count = int(self.request.get("count", 10))
        if count == 0:
            return None
        exprs = paging.expressions(self.ns, self.request.get("expr"))
        keys = paging.sort_keys(self.ns, self.request.get("sort"), exprs)
        rows = paging.page(self.matches, keys, int(self.request.get("start", 0)), count)
        return rows.withColumns(exprs) if exprs else rows

    def items(self) -> DataFrame | None:
        """The page as JSON strings: documents as they were added, or their ids."""
        rows = self.page()
        return None if rows is None else rows.select(self._item(rows).alias("item"))

    def _item(self, rows: DataFrame) -> Column:
        if self.request.get("idsOnly"):
            return F.to_json(F.struct(F.col("id").cast("string").alias("id")))
        if "_raw" in rows.columns:
            return F.col("_raw")
        return F.to_json(F.struct(*[c for c in rows.columns if not c.startswith("_") and "__" not in c]))

    def facets(self) -> DataFrame | None:
        told = self.request.get("facets") or {}
        values = {n: f for n, f in told.items() if "buckets" not in f}
        ranges = {n: f for n, f in told.items() if "buckets" in f}
        parts = []
        if values:
            parts.append(facets.value_facets(self.matches, self.ns, values))
        if ranges:
            found = facets.bucket_facets(self.matches, self.ns, ranges)
            parts.append(found.withColumn("number", F.lit(None).cast("double")))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def response(self) -> dict:
        """Run the parts and assemble the answer (a page and facets: bounded by the request)."""
        began = time.time()
        told = self.request
        several = bool(told.get("facets")) + (int(told.get("count", 10)) > 0) + 1 > 2
        held = self.matches.persist() if several else self.matches
        plan = Search(self.ns, held, told)
        prepared = time.time()
        try:
            total = plan.total().first()["total_found"]
            rows = plan.page() if total else None
            items, exprs = [], {}
            if rows is not None:
                names = list(paging.expressions(self.ns, told.get("expr")))
                page = rows.select(plan._item(rows).alias("_item"), *names).collect()
                for r in page:
                    for n in names:
                        exprs.setdefault(n, []).append(r[n])
                items = [r["_item"] for r in page]
            found = plan.facets() if total else None
            shown: dict[str, list] = {}
            if found is not None:
                for r in sorted(found.collect(), key=lambda r: (r["facet"], r["rank"])):
                    shown.setdefault(r["facet"], []).append({"value": self._value(r), "count": r["count"]})
        finally:
            if several:
                held.unpersist()
        done = time.time()
        return {
            "totalFound": total,
            "start": int(told.get("start", 0)),
            "count": len(items),
            "facets": shown,
            "items": items,
            "exprs": exprs,
            "prepTimeMillis": round(1000 * (prepared - began)),
            "queryTimeMillis": round(1000 * (done - prepared)),
            "serializeTimeMillis": 0,
        }

    def _value(self, row):
        """A facet value in its field's type."""
        if row["text"] is not None:
            return row["text"]
        spec = self.request["facets"][row["facet"]]
        kind = self.ns.fields[spec["field"]].type if "field" in spec else "number"
        if kind == "boolean":
            return bool(row["number"])
        if kind == "date":
            return datetime.fromtimestamp(row["number"], UTC).isoformat()
        return row["number"] if kind == "number" else int(row["number"])


def search(docs: DataFrame, ns: Namespace, request: Mapping) -> dict:
    return Search.plan(docs, ns, request).response()

"""Request JSON -> clause tree -> one boolean column.

A clause's own fields are conditions that all hold; its $and.., $or.., $not.. sub-clauses (any
suffix, object or array) join them.  The only optimiser needed here drops conditions that constrain
nothing, so Catalyst gets one conjunction on bare columns.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import predicates
from ..sources.namespace import Namespace, SchemaError

JOINS = ("$and", "$or", "$not")


@dataclass
class Clause:
    join: str = "$and"
    conditions: dict = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)
    children: list[Clause] = field(default_factory=list)


def parse(told, join: str = "$and") -> Clause:
    """A clause; an array is a clause whose elements are $and clauses."""
    out = Clause(join)
    if told is None:
        return out
    if isinstance(told, (list, tuple)):
        out.children = [parse(x) for x in told]
        return out
    if not isinstance(told, Mapping):
        raise SchemaError(f"a clause is an object or an array, not {told!r}")
    for key, value in told.items():
        if key == "$text":
            out.texts += value if isinstance(value, list) else [value]
        elif kind := next((j for j in JOINS if key.startswith(j)), None):
            out.children.append(parse(value, kind))
        else:
            out.conditions[key] = value
    return out


def compile_clause(ns: Namespace, clause: Clause, lang: str | None = None) -> Column | None:
    """The clause as a column, None if it constrains nothing."""
    own = [predicates.condition(ns, n, v, lang) for n, v in clause.conditions.items()]
    fields = [f for f in ns.fields.values() if f.type == "text" and f.index]
    own += [predicates.alternatives(fields, t, lang) for t in clause.texts]
    children = [(c, compile_clause(ns, c, lang)) for c in clause.children]
    either = clause.join == "$or"
    tests = []
    for child, test in children:
        if child.join == "$not":
            # nothing to negate: the clause holds for all, its negation for none
            tests.append(F.lit(False) if test is None else ~F.coalesce(test, F.lit(False)))
        else:
            tests.append(test)
    if either and not tests:
        return None if any(t is None for t in own) else _fold(or_, own)
    if either:
        union = None if any(t is None for t in tests) else _fold(or_, tests)
        return predicates.all_of([*own, union])
    return predicates.all_of([*own, *tests])


def _fold(join, tests: list[Column]) -> Column | None:
    return reduce(join, tests) if tests else None


def where(ns: Namespace, query, lang: str | None = None) -> Column | None:
    """The request's query as a column; None matches all."""
    return compile_clause(ns, parse(query), lang)

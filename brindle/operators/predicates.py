"""One condition of a request -> a boolean column, or None where it constrains nothing.

Conditions are built on bare (shadow) columns so that the scan can take them over.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import coerce, geo, text
from ..sources.indexing import norm, words
from ..sources.namespace import RANGES, FieldDef, Namespace, SchemaError


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def all_of(tests: list[Column | None]) -> Column | None:
    kept = [t for t in tests if t is not None]
    return reduce(and_, kept) if kept else None


def condition(ns: Namespace, name: str, value, lang: str | None = None) -> Column | None:
    """The condition {name: value}: a list is 'any of', an empty list no constraint."""
    f = ns.declared(name)
    if value is None:
        raise SchemaError(f"field {name}: null is no condition")
    values = value if isinstance(value, (list, tuple)) else [value]
    if f.type == "geo" and values and not isinstance(values[0], Mapping):
        values = [{"from": list(value)}]
    if not values:
        return None
    if f.type == "literal":
        return _literals(f, values)
    if f.type == "text":
        found = [alternatives([f], v, lang) for v in values]
        return None if any(t is None for t in found) else any_of(found)
    one = {"boolean": _boolean, "geo": _geo}.get(f.type, _range)
    tests = [one(ns, f, v) for v in values]
    return None if any(t is None for t in tests) else any_of(tests)


def _each(f: FieldDef, column: str, test: Callable[[Column], Column]) -> Column:
    """A test of a value, or of any element of an array field."""
    return F.exists(column, test) if f.array else test(F.col(column))


def _affix(bare: str, head: bool, tail: bool) -> Callable[[Column], Column]:
    """Starts with, ends with, or both."""

    def test(c: Column) -> Column:
        if head and tail:
            return c.startswith(bare) & c.endswith(bare)
        return c.startswith(bare) if head else c.endswith(bare)

    return test


def _literals(f: FieldDef, values: list) -> Column:
    exact, tests = [], []
    for v in values:
        if v is None:
            raise SchemaError(f"field {f.name}: null is no condition")
        raw = str(v)
        head, tail = raw.endswith("*") and f.prefix, raw.startswith("*") and f.suffix
        if raw == "*" and f.prefix:
            column = F.col(norm(f.name))
            tests.append((F.size(column) > 0) if f.array else column.isNotNull())
            continue
        bare = text.normalise(raw)
        if f.stem and not head and not tail:
            bare = text.STEMMERS.get(f.lang, lambda w: w)(bare)
        if head or tail:
            tests.append(_each(f, norm(f.name), _affix(bare, head, tail)))
        else:
            exact.append(bare)
    if exact:
        if f.array:
            tests.append(F.arrays_overlap(norm(f.name), F.array(*map(F.lit, exact))))
        else:
            tests.append(F.col(norm(f.name)).isin(*exact) if len(exact) > 1 else F.col(norm(f.name)) == exact[0])
    return any_of(tests)


def _bound(f: FieldDef, value):
    if value is None or value == "":
        return None
    if f.type == "date":
        return coerce.constant_seconds(value)
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise SchemaError(f"field {f.name}: {value!r} is no number") from None
    return int(number) if f.type != "number" and number.is_integer() else number


def between(f: FieldDef, told: Mapping) -> Callable[[Column], Column] | None:
    """min, max (inclusive, or not with minExcl, maxExcl); null or absent is unbounded."""
    low, high = _bound(f, told.get("min")), _bound(f, told.get("max"))
    if low is None and high is None:
        return None

    def test(c: Column) -> Column:
        parts = []
        if low is not None:
            parts.append(c > F.lit(low) if told.get("minExcl") else c >= F.lit(low))
        if high is not None:
            parts.append(c < F.lit(high) if told.get("maxExcl") else c <= F.lit(high))
        return reduce(and_, parts)

    return test


def _range(ns: Namespace, f: FieldDef, value) -> Column | None:
    assert f.type in RANGES
    if isinstance(value, Mapping):
        test = between(f, value)
        return None if test is None else _each(f, f.name, test)
    at = _bound(f, value)
    if at is None:
        raise SchemaError(f"field {f.name}: null is no condition")
    return _each(f, f.name, lambda c: c == F.lit(at))


def _boolean(ns: Namespace, f: FieldDef, value) -> Column:
    if isinstance(value, Mapping) or value is None:
        raise SchemaError(f"field {f.name}: {value!r} is no truth value")
    return F.col(f.name) == F.lit(bool(value))


def _geo(ns: Namespace, f: FieldDef, value) -> Column:
    """from, radius, unit; or from, radiusField: the document's own radius in metres, without one it
    covers all; without either the point need only exist."""
    if not isinstance(value, Mapping) or len(value.get("from") or ()) != 2:
        raise SchemaError(f"field {f.name}: a condition needs from: [lat, lon]")
    origin = tuple(float(x) for x in value["from"])
    lat, lon = F.col(f"{f.name}.lat"), F.col(f"{f.name}.lon")
    there = lat.isNotNull() & lon.isNotNull()
    far = geo.distance(lat, lon, origin)
    if value.get("radiusField"):
        own = ns.declared(value["radiusField"])
        if own.type not in RANGES:
            raise SchemaError(f"field {own.name} is no number")
        return there & (F.col(own.name).isNull() | (far <= F.col(own.name)))
    if value.get("radius") is None:
        return there
    unit = value.get("unit", "km")
    if unit not in geo.RADIUS_UNITS:
        raise SchemaError(f"unknown unit {unit}")
    metres = float(value["radius"]) * geo.RADIUS_UNITS[unit]
    near = geo.box(lat, lon, origin, metres)
    return (there if near is None else near) & (far <= F.lit(metres))


def alternatives(fields: list[FieldDef], query: str, lang: str | None = None) -> Column | None:
    """Text search: alternatives are parted by ' or ' or '|'; all words of one must be in one field.

    A field's words are bound once for all of its tests: where they aren't stored, but made from the
    text as it is read, Catalyst would otherwise repeat their making for every test of a filter."""
    import re

    tests = []
    parts = re.split(r"\s+or\s+|\|", str(query).lower())
    for f in fields:
        language = lang or f.lang
        stop = set(text.stop_words(language)) if f.stop else set()
        own = []
        for part in parts:
            found = [t for t in text.tokenise(part, f.separators) if text.normalise(t) not in stop]
            hits = [h for h in (_word(f, t, language) for t in found) if h is not None]
            if hits:
                own.append(hits)
        if own:
            tests.append(_bound_once(words(f.name), own))
    return any_of(tests) if tests else None


def _bound_once(column: str, parts: list[list[Callable[[Column], Column]]]) -> Column:
    """Any of the parts, of which all tests hold, of one value of a column."""
    return F.exists(F.array(column), lambda own: any_of([reduce(and_, [test(own) for test in hits]) for hits in parts]))


def _word(f: FieldDef, token: str, lang: str) -> Callable[[Column], Column] | None:
    """A test of an array of words."""
    bare = text.normalise(token)
    if token == "*" and f.prefix:
        return lambda own: F.size(own) > 0
    if not bare:
        return None
    head, tail = token.endswith("*") and f.prefix, token.startswith("*") and f.suffix
    if head or tail:
        return lambda own: F.exists(own, _affix(bare, head, tail))
    word = text.STEMMERS.get(lang, lambda w: w)(bare) if f.stem else bare
    return lambda own: F.array_contains(own, word)

"""Namespaces: named document collections with a declared field schema."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from . import files

#: Which options a field type has, and its defaults.
TYPES = {
    "literal": {"sort", "facet", "source", "prefix", "suffix", "stem", "stopWords"},
    "text": {"source", "prefix", "suffix", "stem", "stopWords", "separators"},
    "number": {"sort", "facet"},
    "integer": {"sort", "facet"},
    "smallinteger": {"sort", "facet"},
    "date": {"sort", "facet"},
    "boolean": {"sort", "facet", "source"},
    "geo": set(),
}
COMMON = {"type", "index", "array", "defaultValue", "lang", "sortPrecision"}
SEPARATORS = ("unicode", "ascii")
RANGES = ("number", "integer", "smallinteger", "date")


class SchemaError(ValueError):
    """A namespace configuration or request that can't be used."""


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: str
    index: bool = True
    array: bool = False
    sort: bool = False
    facet: bool = False
    prefix: bool = True
    suffix: bool = False
    stem: bool = False
    stop: bool = False
    sources: tuple[str, ...] = ()
    default: object = None
    lang: str = "en"
    separators: str = "unicode"

    @classmethod
    def parse(cls, name: str, told: Mapping, lang: str) -> FieldDef:
        kind = told.get("type")
        if kind not in TYPES:
            raise SchemaError(f"field {name}: unknown type {kind!r}")
        for option in ("sort", "facet", "source"):
            if told.get(option) and option not in TYPES[kind]:
                raise SchemaError(f"field {name}: a {kind} field has no option {option}")
        separators = told.get("separators", "unicode")
        if separators not in SEPARATORS:
            raise SchemaError(f"field {name}: unknown separators {separators!r}")
        source = told.get("source") or ()
        sources = tuple(s.strip() for s in source.split(",")) if isinstance(source, str) else tuple(source)
        if len(sources) > 1 and kind != "text":
            raise SchemaError(f"field {name}: a {kind} field has one source")
        return cls(
            name,
            kind,
            index=told.get("index", True),
            array=bool(told.get("array", False)),
            sort=bool(told.get("sort", False)),
            facet=bool(told.get("facet", False)),
            prefix=bool(told.get("prefix", True)),
            suffix=bool(told.get("suffix", False)),
            stem=bool(told.get("stem", False)),
            stop=bool(told.get("stopWords", kind == "text")),
            sources=sources,
            default=told.get("defaultValue"),
            lang=told.get("lang", lang),
            separators=separators,
        )


@dataclass(frozen=True)
class Namespace:
    name: str
    prefix: str
    fields: Mapping[str, FieldDef]
    lang: str = "en"
    expiration: str | None = None
    composites: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    config: Mapping = field(default_factory=dict, compare=False)

    @classmethod
    def parse(cls, config: Mapping) -> Namespace:
        for key in ("name", "prefix"):
            if not config.get(key):
                raise SchemaError(f"a namespace needs a {key}")
        lang = config.get("defaultLang", "en")
        fields = {n: FieldDef.parse(n, f, lang) for n, f in (config.get("fields") or {}).items()}
        for f in fields.values():
            for s in f.sources:
                if s not in fields:
                    raise SchemaError(f"field {f.name}: its source {s} is not declared")
        groups = {}
        for key in ("composites", "compounds"):
            for n, told in (config.get(key) or {}).items():
                parts = tuple(told["fields"]) if isinstance(told, Mapping) else tuple(told)
                if len(parts) < 2:
                    raise SchemaError(f"{key[:-1]} {n} needs two fields at least")
                for p in parts:
                    if p not in fields or fields[p].type == "text":
                        raise SchemaError(f"{key[:-1]} {n} can't hold field {p}")
                if key == "composites":
                    groups[n] = parts
        expiration = config.get("expirationField")
        if expiration and (expiration not in fields or fields[expiration].type not in RANGES):
            raise SchemaError(f"expirationField {expiration} is no declared date or number")
        return cls(config["name"], config["prefix"], fields, lang, expiration, groups, dict(config))

    def declared(self, name: str) -> FieldDef:
        """A field that can be queried."""
        if name not in self.fields:
            raise SchemaError(f"unknown field {name}")
        if not self.fields[name].index:
            raise SchemaError(f"field {name} is not indexed")
        return self.fields[name]


class Registry:
    """Namespace configurations, one JSON file each in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, name: str) -> str:
        return f"{self.root}/_namespaces/{name}.json"

    def create(self, config: Mapping) -> Namespace:
        """Declare a namespace; an existing one of the name gets the new configuration."""
        ns = Namespace.parse(config)
        files.write_text(self.spark, self._file(ns.name), json.dumps(config, sort_keys=True))
        return ns

    def open(self, name: str) -> Namespace:
        if not files.exists(self.spark, self._file(name)):
            raise KeyError(name)
        return Namespace.parse(json.loads(files.read_text(self.spark, self._file(name))))

    def configs(self) -> dict[str, dict]:
        found = [n[:-5] for n in files.names(self.spark, f"{self.root}/_namespaces") if n.endswith(".json")]
        return {n: dict(self.open(n).config) for n in found}

    def drop(self, name: str) -> None:
        """Forget a namespace and delete its documents."""
        files.delete(self.spark, self._file(name))
        files.delete(self.spark, f"{self.root}/{name}")

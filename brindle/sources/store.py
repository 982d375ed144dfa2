"""Document store: Parquet snapshots of a namespace, named by a log of versions.

A write reads the current snapshot, writes the next one to a folder of its own, and commits by
creating the next entry of the log, which names that folder.  Readers always see a whole version; a
failed write leaves nothing but an unreferenced folder.  Of two writers that start from one version
one finds the entry taken, and works its change out again on the version that the other committed,
so no write is lost (where the file system creates files exclusively, as HDFS does).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import without
from ..operators.versions import changed_fields, latest, unexpired
from ..plans.search import search
from . import files
from .indexing import indexed, read_json
from .namespace import Namespace, Registry, SchemaError

SEQ = "_seq"
#: Times that a write is worked out again when others commit first; seconds that an entry may take.
ATTEMPTS, PATIENCE = 20, 10.0


class WriteConflict(RuntimeError):
    """Other writers committed first every time."""


class Collection:
    """The documents of one namespace."""

    def __init__(self, spark: SparkSession, root: str, ns: Namespace):
        self.spark, self.ns = spark, ns
        self.path = f"{root.rstrip('/')}/{ns.name}"

    # --- snapshots
    def _entry(self, version: int) -> str:
        return f"{self.path}/_log/{version:012d}"

    def _entries(self) -> list[int]:
        return [int(n) for n in files.names(self.spark, f"{self.path}/_log") if n.isdigit()]

    def _folder(self, version: int) -> str | None:
        """The folder of a version; None if its writer died between making and filling the entry."""
        until = time.monotonic() + PATIENCE
        while not (found := files.read_text(self.spark, self._entry(version))) and time.monotonic() < until:
            time.sleep(0.2)
        return found or None

    def _current(self) -> tuple[int, str | None, int]:
        """The current version and its folder, 0 and None if there is none, and the next version."""
        entries = self._entries()
        following = max(entries, default=0) + 1
        for version in sorted(entries, reverse=True):
            if folder := self._folder(version):
                return version, folder, following
        return 0, None, following

    def version(self) -> int:
        """The current snapshot's number, 0 if there is none."""
        return self._current()[0]

    def raw(self) -> DataFrame | None:
        """_seq, id, _raw of the current snapshot, with typed and shadow columns."""
        return self._snapshot(self._current()[1])

    def _snapshot(self, folder: str | None) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{folder}") if folder else None

    def _commit(self, change: Callable[[DataFrame | None], DataFrame | None]) -> int:
        """Replace the current snapshot by change(snapshot), None for no change; returns the
        current version."""
        for _ in range(ATTEMPTS):
            at, folder, following = self._current()
            rows = change(self._snapshot(folder))
            if rows is None:
                return at
            made = f"v{following}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{made}")
            if files.create_text(self.spark, self._entry(following), made):
                return following
            files.delete(self.spark, f"{self.path}/{made}")
        raise WriteConflict(self.ns.name)

    def vacuum(self) -> None:
        """Delete the snapshots before the current one; those that writers may be making stay."""
        at, folder, _ = self._current()
        for name in files.names(self.spark, self.path):
            if name.startswith("v") and name != folder and int(name[1:].split("-")[0]) <= at:
                files.delete(self.spark, f"{self.path}/{name}")

    # --- writing
    def add(self, docs: DataFrame) -> int:
        """Upsert documents, a frame with one JSON string a row (column value) in order of arrival;
        of equal ids the last stays, and a known id keeps its place.  Returns the new version."""
        rows = read_json(docs, self.ns).withColumn("_at", F.monotonically_increasing_id())
        bad = rows.where("id is null or id = ''").limit(1).count()
        if bad:
            raise SchemaError("a document needs an id")
        return self.upsert(indexed(rows, self.ns))

    def upsert(self, rows: DataFrame) -> int:
        """Upsert indexed rows (id, _at and the indexed columns).  If every document is stored already
        as it is, and with the same columns, nothing is written."""
        batch = latest(rows, "id", F.col("_at"))

        def change(old: DataFrame | None) -> DataFrame | None:
            if old is None:
                return batch.withColumnRenamed("_at", SEQ)
            if {*old.columns} - {SEQ} == {*batch.columns} - {"_at"}:
                new = without(batch, old, "id").select("id")
                if new.union(changed_fields(old, batch, "id", ["_raw"]).select("id")).isEmpty():
                    return None
            most = old.agg(F.max(SEQ)).first()[0]
            base = -1 if most is None else most
            placed = batch.join(old.select("id", SEQ), "id", "left").withColumn(
                SEQ, F.coalesce(SEQ, F.col("_at") + F.lit(base + 1))
            )
            return without(old, batch, "id").unionByName(placed.drop("_at"), allowMissingColumns=True)

        return self._commit(change)

    def add_documents(self, docs: Iterable[Mapping]) -> int:
        """Upsert a small batch of dictionaries."""
        lines = [(json.dumps(d),) for d in docs]
        return self.add(self.spark.createDataFrame(lines, "value string").coalesce(1))

    def reindex(self) -> int:
        """Derive every column again from the stored JSON."""

        def change(old: DataFrame | None) -> DataFrame | None:
            if old is None:
                return None
            rows = read_json(old.select(F.col("_raw").alias("value")), self.ns).join(old.select("id", SEQ), "id")
            return indexed(rows, self.ns)

        return self._commit(change)

    def delete(self, ids: Iterable) -> int:
        """Delete by id: strings, numbers, or objects with an id.  Returns the new version."""
        wanted = [str(x["id"] if isinstance(x, Mapping) else x) for x in ids]
        return self.delete_rows(self.spark.createDataFrame([(x,) for x in wanted], "id string"))

    def delete_rows(self, ids: DataFrame) -> int:
        return self._commit(lambda old: without(old, ids, "id") if old is not None else None)

    def expire(self, now: datetime | None = None) -> int:
        """Drop documents whose expiration field is not after now."""

        def change(old: DataFrame | None) -> DataFrame | None:
            kept = unexpired(old, self.ns.expiration, self._now(now)) if old is not None and self.ns.expiration else None
            gone = kept is not None and not old.where(F.col(self.ns.expiration) <= F.lit(self._now(now))).isEmpty()
            return kept if gone else None

        return self._commit(change)

    def _now(self, now: datetime | None) -> int:
        return int((now or datetime.now(UTC)).timestamp())

    # --- reading
    def docs(self, now: datetime | None = None) -> DataFrame:
        """Indexed documents that have not expired."""
        rows = self.raw()
        if rows is None:
            empty = self.spark.createDataFrame([], "value string")
            rows = indexed(read_json(empty, self.ns), self.ns).withColumn(SEQ, F.lit(0).cast("long"))
        return unexpired(rows, self.ns.expiration, self._now(now)) if self.ns.expiration else rows

    def get(self, doc_id) -> dict:
        """A document by id; KeyError without one."""
        row = self.docs().where(F.col("id") == str(doc_id)).select("_raw").first()
        if row is None:
            raise KeyError(doc_id)
        return json.loads(row["_raw"])

    def search(self, request: Mapping) -> dict:
        return search(self.docs(), self.ns, request)

    def drop(self) -> None:
        files.delete(self.spark, self.path)


class Engine:
    """Namespaces and their collections under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.registry = Registry(spark, root)

    def create_namespace(self, config: Mapping) -> Collection:
        return Collection(self.spark, self.root, self.registry.create(config))

    def use_namespace(self, name: str) -> Collection:
        return Collection(self.spark, self.root, self.registry.open(name))

    def namespace_configs(self) -> dict[str, dict]:
        return self.registry.configs()

    def drop_namespace(self, name: str) -> None:
        self.registry.drop(name)

    def handle(self, message: Mapping) -> dict:
        """A message {action, ns, input}, as a server would pass it on; errors become replies."""
        try:
            action, ns, told = message.get("action"), message.get("ns"), message.get("input")
            if action == "createNamespace":
                return dict(self.create_namespace(told).ns.config)
            if action == "getNamespaceConfig":
                return dict(self.registry.open(ns).config)
            collection = self.use_namespace(ns)
            if action == "search":
                return collection.search(told)
            if action == "getDocument":
                return collection.get(told)
            if action == "addDocuments":
                collection.add_documents(told)
                return {"success": True, "count": len(told)}
            if action == "deleteDocuments":
                collection.delete(told)
                return {"success": True}
            raise SchemaError(f"unknown action {action}")
        except Exception as error:  # the reply carries it
            return {"success": False, "error": f"{type(error).__name__}: {error}"}


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a line, as `Collection.add` takes them."""
    return spark.read.text(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows as JSON documents."""
    return spark.read.parquet(path).select(F.to_json(F.struct("*")).alias("value"))


def write_documents(df: DataFrame, path: str) -> None:
    """The documents of a search or collection as JSON lines."""
    df.select(F.col("_raw").alias("value")).write.text(path)

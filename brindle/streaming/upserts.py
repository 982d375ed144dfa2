"""Streams of documents into a collection: visible once the micro-batch is committed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Collection


def upsert_stream(lines: DataFrame, collection: Collection, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert a stream of JSON strings (column value).  A replayed micro-batch upserts the same ids
    again, so the result is the same."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            collection.add(batch)

    writer = lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def delete_stream(ids: DataFrame, collection: Collection, checkpoint: str, **trigger) -> StreamingQuery:
    """Delete a stream of ids (column id)."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            collection.delete_rows(batch)

    writer = ids.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def purge(collection: Collection, now: datetime | None = None) -> int:
    """One round of expiry, and of deleting old snapshots; run it on a schedule."""
    version = collection.expire(now)
    collection.vacuum()
    return version

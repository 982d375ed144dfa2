"""Sharding by rendezvous hashing of stable record keys over weighted shards (native).

Every shard draws a number for every key, u in (0, 1) from a hash of (key, shard); the record
goes to the shard with the largest -weight / ln(u).  The key and the shard list alone decide, so
adding a shard moves records only into it, an expected share of its weight.

Slots within a shard are numbered in two levels: records are dealt to cells of a shard by hash,
cells are counted (shards x cells rows), and a record's slot is its cell's offset plus its place
in the cell.  No task sees a whole shard.

Defined cases: a null key is a key of its own; a null text has no bytes; repeated rows get slots
of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CELLS = 256
SEED = 0x5EED


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The shard's number for a key; larger wins."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), key, F.lit(shard)), 11)
    unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.lit(float(weight)) / F.log(unit)


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard (its place in weights) of a key; shards of weight 0 get nothing."""
    draws = [F.struct(draw(key, i, w).alias("at"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return F.array_max(F.array(*draws))["shard"]


def assign(
    docs: DataFrame,
    weights: Sequence[float],
    grown: Sequence[float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    grown: the weights with further shards appended, for grown_shard."""
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    grown = list(grown or [*weights, 1.0])
    more = [F.struct(draw(F.col("doc_id"), i, w).alias("at"), F.lit(i).alias("shard")) for i, w in enumerate(grown) if w > 0]
    records = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("uid"),
    )
    records = records.withColumn("draws", F.array(*more)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.array_max(F.slice("draws", 1, sum(w > 0 for w in weights)))["shard"].alias("shard"),
        F.array_max("draws")["shard"].alias("grown_shard"),
        F.pmod(F.xxhash64("uid"), F.lit(CELLS)).cast("int").alias("cell"),
    )
    records = written(records, "shards")
    offsets = records.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "cell").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32")
    placed = records.withColumn("place", F.row_number().over(within))
    # offsets has at most shards x CELLS rows, whatever the input
    return placed.join(F.broadcast(offsets), ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
        "grown_shard",
    )

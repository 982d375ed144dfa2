"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: The letters that A-Z lower-casing folds.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that vectorised steps take at once.
PORTION = 4 << 20
#: A key is hot if it has more than 1 / HOT_KEYS of all rows (and HOT_ROWS at least): there are at most
#: HOT_KEYS of them, whatever the input.  The rows of a hot key are dealt to SALTS tasks.
HOT_KEYS, HOT_ROWS, SALTS = 1 << 12, 1 << 14, 64


@cache
def _private_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="brindle-")


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by driver and executors: spark.checkpoint.dir, else the folder given to
    setCheckpointDir; a private one only on a local master, where there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        root = _private_root()
    return f"{root.rstrip('/')}/brindle"


#: Folders of the tables written so far, one list for each `temporary` that is open.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, but for those to keep, are deleted at the end.  What leaves must be
    written with keep, since frames are read again whenever they are used."""
    own: list[str] = []
    token = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(token)
        for path in own:
            _delete(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage,
    survives lost executors, and fixes whatever was numbered by task.  A table to keep outlives
    the innermost `temporary`."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    held = _open.get()[:-1] if keep else _open.get()
    if held:
        held[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: Sequence[str], name: str) -> str:
    """name, with underscores put before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns, whatever stands in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a written table with a unique row number, and that column's name: an identity for
    rows whatever their ids, that a recomputed task can't change."""
    uid = free_name(docs.columns, "__uid")
    return written(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered"), uid


def without_rows(rows: DataFrame, uid: str, dropped: DataFrame, docs: DataFrame) -> DataFrame:
    """The numbered rows whose number is not in dropped(uid), with the columns of docs."""
    gone = dropped.select(F.col("uid").alias(uid))
    return rows.join(gone, uid, "left_anti").select(*columns_of(docs))


def spread_join(rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str, by: Sequence[str], how: str = "left") -> DataFrame:
    """rows.join(table, on, how) where any key may hold a third of all rows, with no help from
    adaptive execution.

    table is written, has at most one row a key, and in `weight` the number of its rows; weight is
    dropped.  The rows of hot keys are dealt out by the columns `by`, and the hot keys' rows of
    table copied to match; the hot keys themselves (HOT_KEYS of them at most) are broadcast."""
    on = list(on)
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) > max(HOT_ROWS, total // HOT_KEYS)).select(*on)
    if hot.isEmpty():
        return rows.join(table.drop(weight), on, how)
    salt = free_name([*rows.columns, *table.columns], "__salt")
    mark = F.broadcast(hot.withColumn(salt, F.lit(True)))
    dealt = F.when(F.col(salt), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    copies = F.when(F.col(salt), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = rows.join(mark, on, "left").withColumn(salt, dealt)
    right = table.drop(weight).join(mark, on, "left").withColumn(salt, F.explode(copies))
    return left.join(right, [*on, salt], how).drop(salt)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that `written` left in the shared folder."""
    _delete(spark, scratch_root(spark))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def owners_for(spark: SparkSession, amount: int, each: int) -> int:
    """How many owners share `amount` (rows, bytes) so that none has much more than `each`."""
    return max(shuffle_partitions(spark), -(-amount // each))


def to_owners(messages: DataFrame, owners: int) -> DataFrame:
    """Messages dealt to one task for each owner (column owner, 0 to owners - 1)."""
    return messages.repartitionById(owners, "owner")


def utf8(text_array) -> list[bytes]:
    """Texts of an Arrow string column as bytes; null counts as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in text_array.cast(pa.binary()).to_pylist()]


def portions(batch, column: int, size: int = PORTION) -> Iterator:
    """Slices of an Arrow batch with about `size` bytes of text in a column: bounds what vectorised
    steps hold at once (one longer text is a slice of its own)."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + size)))
        yield batch.slice(start, end - start)
        start = end


@contextmanager
def arrow_bytes(spark: SparkSession, size: int = PORTION) -> Iterator[None]:
    """Arrow batches made inside have about `size` bytes at most (a longer row is one of its own): the
    default of 64 MB a batch, twice over in an executor and again in Python, is memory outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(col):
    return F.lower(F.sha2(F.coalesce(col, F.lit("")).cast("binary"), 256))

"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each task walks its rows in chunks of bounded size, normalises the texts, and for each chunk
   passes its rows on in portions and sends the sorted distinct fingerprints, cut into owner ranges
   and Golomb-coded (parameter a power of two), one message per owner.
2. An owner decodes the messages of its range and answers each with a bitmap: which of its
   fingerprints some other chunk holds as well.
3. Rows whose bit is set, or whose fingerprint repeats inside their own chunk, are suspects.
   Only suspects travel with their text; grouping by the text itself is the byte verification.

A hot text is sent once per chunk, the verification aggregates before its shuffle, and rows meet
their class by a join that deals out hot classes, so a group that holds a third of all rows costs
each task one message entry and one partial row, and gathers nowhere.  There are as many owners
as the rows call for, each a task of its own.

Defined cases: a null text counts as empty; a text of white space alone is one space; a null
doc_id sorts after all others; of rows equal in text and doc_id exactly one is kept; texts are
compared as bytes, so invalid UTF-8 is as good as any; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PORTION, arrow_bytes, numbered, owners_for, portions, spread_join, temporary, to_owners, utf8, without_rows, written

FP_BITS = 48
CHUNK_BYTES = 32 << 20
#: Rows for each owner of a range of fingerprints, 32 MB of them.
OWNER_PRINTS = 1 << 22
WHITE = b" \t\n\x0b\x0c\r"


def normalise(raw: bytes) -> bytes:
    """Every run of ASCII white space becomes one space; ends are not stripped."""
    if not raw:
        return raw
    body = b" ".join(raw.split())
    if not body:
        return b" "
    return (b" " if raw[0] in WHITE else b"") + body + (b" " if raw[-1] in WHITE else b"")


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct uint64 values: quotients of the gaps in unary, then k-bit remainders."""
    gaps = np.diff(values, prepend=np.uint64(0))
    gaps[1:] -= np.uint64(1)
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low = gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, ::-1] & np.uint64(1)
    return np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8)).tobytes()


def golomb_decode(payload: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(payload, np.uint8))
    ends = np.flatnonzero(bits[: _unary_limit(bits, n)])[:n]
    start = (int(ends[-1]) // 8 + 1) * 8
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = bits[start : start + n * k].reshape(n, k).astype(np.uint64)
        gaps += low @ (np.uint64(1) << np.arange(k, dtype=np.uint64)[::-1])
    gaps[1:] += np.uint64(1)
    return np.cumsum(gaps, dtype=np.uint64)


def _unary_limit(bits: np.ndarray, n: int) -> int:
    """A prefix of bits that surely holds the n ones of the unary part."""
    size = min(len(bits), 4 * n + 64)
    while size < len(bits) and np.count_nonzero(bits[:size]) < n:
        size = min(len(bits), 2 * size)
    return size


def golomb_parameter(span: int, n: int) -> int:
    """The power of two nearest below 0.69 times the mean gap."""
    return max(0, int(0.69 * span / max(n, 1)).bit_length() - 1)


def _send(owners: int, bits: int):
    span = -(-(1 << bits) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        chunk, held, size = 0, [], 0
        for part in (part for whole in batches for part in portions(whole, 1)):
            norms = [normalise(x) for x in utf8(part.column(1))]
            digests = b"".join(hashlib.sha256(x).digest() for x in norms)
            # numbers are copied: a slice would keep its whole batch, texts and all
            doc_ids, row_ids = (pa.array(part.column(i).to_pylist(), pa.int64()) for i in (0, 2))
            held.append((doc_ids, row_ids, digests, pa.array(norms, pa.binary())))
            size += sum(map(len, norms)) + 64 * len(norms)
            if size >= CHUNK_BYTES:
                yield from emit(base + chunk, held)
                chunk, held, size = chunk + 1, [], 0
        if held:
            yield from emit(base + chunk, held)

    def emit(chunk: int, held: list) -> Iterator[pa.RecordBatch]:
        """held: the chunk's portions, let go one by one as they are sent."""
        words = np.frombuffer(b"".join(digests for _, _, digests, _ in held), ">u8")
        prints = words[::4].astype(np.uint64) >> np.uint64(64 - bits)
        keys, back, counts = np.unique(prints, return_inverse=True, return_counts=True)
        owner = keys // np.uint64(span)
        cuts = np.flatnonzero(np.diff(owner, prepend=np.uint64(owners + 1)))
        ends = np.append(cuts[1:], len(keys))
        sizes = ends - cuts
        first = np.repeat(cuts, sizes)
        start = 0
        held.reverse()
        while held:
            doc_ids, row_ids, digests, norms = held.pop()
            n = len(norms)
            mine = back[start : start + n]
            yield pa.record_batch(
                [
                    pa.array(np.zeros(n, np.int32)),
                    pa.array(np.full(n, chunk)),
                    pa.array(owner[mine].astype(np.int32)),
                    pa.array((mine - first[mine]).astype(np.int32)),
                    pa.array(counts[mine] > 1),
                    pa.array(np.arange(start, start + n, dtype=np.int32)),
                    doc_ids,
                    row_ids,
                    pa.array([digests[i : i + 32].hex() for i in range(0, 32 * n, 32)], pa.string()),
                    norms,
                    pa.nulls(n, pa.binary()),
                ],
                names=NAMES,
            )
            start += n
        ks = [golomb_parameter(span, int(m)) for m in sizes]
        m = len(cuts)
        yield pa.record_batch(
            [
                pa.array(np.ones(m, np.int32)),
                pa.array(np.full(m, chunk)),
                pa.array(owner[cuts].astype(np.int32)),
                pa.array(sizes.astype(np.int32)),
                pa.nulls(m, pa.bool_()),
                pa.array(ks, pa.int32()),
                pa.nulls(m, pa.int64()),
                pa.nulls(m, pa.int64()),
                pa.nulls(m, pa.string()),
                pa.nulls(m, pa.binary()),
                pa.array(
                    [golomb_encode(keys[a:b] - owner[a] * np.uint64(span), k) for a, b, k in zip(cuts, ends, ks)],
                    pa.binary(),
                ),
            ],
            names=NAMES,
        )

    return run


#: kind 0: a row (slot = place among the chunk's prints for that owner, pos = place in the chunk);
#: kind 1: a message (slot = number of prints, pos = Golomb parameter).
NAMES = ["kind", "chunk", "owner", "slot", "twice", "pos", "doc_id", "row_id", "text_sha256", "norm", "payload"]
SENT = (
    "kind int, chunk long, owner int, slot int, twice boolean, pos int, doc_id long, row_id long, "
    "text_sha256 string, norm binary, payload binary"
)


def _answer(owners: int, bits: int):
    """All messages of an owner: 64-bit words of 'another chunk has it too'."""
    span = -(-(1 << bits) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, places, values = [], [], []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for chunk, owner, n, k, payload in zip(*cols):
                chunks.append(chunk)
                places.append(owner)
                values.append(golomb_decode(payload, n, k))
        if not values:
            return
        sizes = np.array([len(x) for x in values])
        keys = np.concatenate(values) + np.repeat(np.array(places, np.uint64) * np.uint64(span), sizes)
        _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        hit = counts[back] > 1
        out = ([], [], [])
        start = 0
        for chunk, owner, n in zip(chunks, places, sizes):
            bits = hit[start : start + n]
            start += n
            if bits.any():
                padded = np.zeros(-(-n // 64) * 64, np.uint8)
                padded[:n] = bits
                words = np.packbits(padded, bitorder="little").view("<i8")
                out[0].append(chunk)
                out[1].append(owner)
                out[2].append(words.tolist())
        yield pa.record_batch(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64()))],
            names=["chunk", "owner", "words"],
        )

    return run


def duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, fp_bits: int = FP_BITS
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and row_id, the long of
    row_col where given."""
    spark = docs.sparkSession
    owners = owners_for(spark, docs.count(), OWNER_PRINTS)
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row_id")
    )
    more = ["row_id"] if row_col else []
    # not parted by kind: Spark would sort the rows, texts and all, to write them so
    with arrow_bytes(spark, PORTION):
        sent = written(source.mapInArrow(_send(owners, fp_bits), SENT), "exact-sent")

    messages = sent.where("kind = 1").select("chunk", "owner", F.col("slot").alias("n"), "pos", "payload")
    answers = written(
        to_owners(messages, owners).mapInArrow(_answer(owners, fp_bits), "chunk long, owner int, words array<long>"),
        "exact-answers",
    )
    # small answers are broadcast by Spark's own size check, larger ones joined by a shuffle
    rows = sent.where("kind = 0").join(answers, ["chunk", "owner"], "left")
    rows = rows.withColumn(
        "suspect", F.col("twice") | F.coalesce(F.expr("getbit(element_at(words, int(slot div 64) + 1), slot % 64) = 1"), F.lit(False))
    )
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "chunk", "pos")
    suspects = rows.where("suspect")
    classes = (
        suspects.groupBy("text_sha256", "norm")
        .agg(F.min(me).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        .select("text_sha256", "keep", "group_size", F.col("group_size").alias("rows"))
    )
    classes = written(classes, "exact-classes")
    single = rows.where("not suspect").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
        *more,
    )
    members = suspects.select("text_sha256", "doc_id", "chunk", "pos", *more)
    grouped = spread_join(members, classes, ["text_sha256"], "rows", ["chunk", "pos"], "inner").select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("keep.chunk") == F.col("chunk")) & (F.col("keep.pos") == F.col("pos"))).alias("kept"),
        "text_sha256",
        *more,
    )
    return single.unionByName(grouped)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns unchanged."""
    rows, uid = numbered(docs)
    with temporary(docs.sparkSession):
        found = duplicate_classes(rows, id_col, text_col, uid).where("not kept").select(F.col("row_id").alias("uid"))
        dropped = written(found, "exact-drops", keep=True)
    return without_rows(rows, uid, dropped, docs)

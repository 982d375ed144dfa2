"""Removal of repeated word windows with a count-min prefilter.

A window is 35 consecutive words.  Its anchor is the least hash among its 18 runs of 18 words: a
window that starts in two places has its anchor in two places, so counting anchors (about a tenth
as many as windows) never counts a window too low.

1. Each task sketches the anchors of its rows: for each sketch row the cells it touches, once or
   more often.  Owners of cell slices merge the partial sketches into one bit per cell: count two
   or more.  The merged sketch has at most 2 x 2^SKETCH_BITS_CAP bits (64 MB) and is broadcast;
   its width follows the size of the input up to that cap.  Beyond it (about 2 GB of text) the
   estimates grow looser, more windows reach the second pass, and results stay exact.
2. Each task hashes its windows to 128 bits and keeps those whose anchor is estimated repeated.
   A window that repeats inside a chunk of rows is known to be repeated; the chunk announces it
   without an address.  Other suspects go to the owner of their hash with an address (hash of the
   text, position).  Owners group exactly and send the addresses of repeated windows, packed, to
   the owners of the texts, which assemble one row for each text.
3. Texts meet their rows by the 128-bit hash of the text (equal texts have equal
   answers), and covered words go.

A chunk sends each window once and handles equal texts once, so a text or passage that a third of
all rows share costs an owner one entry for each chunk.

Defined cases: null and wordless texts have no words; documents shorter than a window lose
nothing; windows never span documents; repeated rows and null ids are ordinary rows; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

WINDOW = 35
CHUNK_BYTES = 8 << 20
SKETCH_ROWS = 2
SKETCH_BITS_CAP = 28
SLICE_BITS = 20
FLUSH = 1 << 21
BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)
#: text, then its 128-bit hash
KEYED = ("coalesce(text, '') as text", "xxhash64(text) as t1", "xxhash64(7, text) as t2")


class Words:
    """The words of several texts as one array of 128-bit hashes, and where each text lies."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        flat = split.values[int(offsets[0]) : int(offsets[-1])]
        full = pc.greater(pc.binary_length(flat), 0)
        seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        self.bounds = seen[offsets - offsets[0]]
        coded = flat.filter(full).dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        digests = np.frombuffer(
            b"".join([xxhash.xxh128_digest(x) for x in coded.dictionary.cast(pa.binary()).to_pylist()]), np.uint64
        ).reshape(-1, 2)
        self.words = [digests[:, i][self.codes] if len(digests) else np.zeros(0, np.uint64) for i in (0, 1)]

    def starts(self, n: int) -> np.ndarray:
        """Mask over words: an n-word window of one text starts here."""
        total = len(self.words[0])
        mask = np.zeros(total + 1, np.int8)
        low, high = self.bounds[:-1], self.bounds[1:] - n + 1
        fits = high > low
        np.add.at(mask, low[fits], 1)
        np.add.at(mask, high[fits], -1)
        return np.cumsum(mask[:total], dtype=np.int8).astype(bool)


def rolling(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of the n words from each place on, sum of word * base^offset modulo 2^64."""
    total = len(words)
    if total < n:
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    up = np.ones(total, np.uint64)
    down = np.ones(total - n + 1, np.uint64)
    up[1:], down[1:] = np.uint64(base), np.uint64(inverse)
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return (sums[n:] - sums[:-n]) * down


def scramble(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each n consecutive values."""
    width = 1
    while 2 * width <= n:
        x = pick(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the anchor hash of each, and the hash of each distinct anchor place."""
    gram = (window + 1) // 2
    valid = words.starts(window)
    where = np.flatnonzero(valid)
    none = np.zeros(0, np.uint64)
    if not len(where):
        return where, none, none
    grams = scramble(rolling(words.words[0], gram, BASE[0]), MIX[0])
    span = window - gram + 1
    least = sliding(grams, span, np.minimum)  # place i: the least gram of the window from i on
    own = np.where(valid[: len(least)], least, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), own, np.zeros(span - 1, np.uint64)])
    most = sliding(padded, span, np.maximum)  # place k: the largest of the least ones whose window covers gram k
    chosen = (most[: len(grams)] == grams) & (most[: len(grams)] != 0)
    return where, least[where], grams[chosen]


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return scramble(keys + np.uint64(row), MIX[row % 2]) >> np.uint64(64 - bits)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in portions of about CHUNK_BYTES of text (a longer text is a portion of its own)."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy()
        start = 0
        for end in range(1, len(lengths) + 1):
            size += int(lengths[end - 1]) + 16
            if size >= CHUNK_BYTES:
                held.append(batch.slice(start, end - start))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, start = [], 0, end
        if start < len(lengths):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sketch(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for chunk in _chunks(batches):
            found = anchors(Words(chunk.column(0)), window)[2]
            held.append(found)
            size += len(found)
            if size >= FLUSH:
                yield from flush(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from flush(np.concatenate(held))

    def flush(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(SKETCH_ROWS):
            cell, counts = np.unique(cells(keys, row, bits), return_counts=True)
            part = (cell >> np.uint64(SLICE_BITS)).astype(np.int64)
            offset = (cell & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint32) << np.uint32(1)
            offset |= (counts > 1).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            yield pa.record_batch(
                [
                    pa.array(part[cuts] * SKETCH_ROWS + row, pa.int64()),
                    pa.array([x.tobytes() for x in np.split(offset, cuts[1:])], pa.binary()),
                ],
                names=["slice", "cells"],
            )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if part not in merged:
                merged[part] = np.zeros(1 << SLICE_BITS, np.uint8)
            got = np.frombuffer(payload, np.uint32)
            place = got >> np.uint32(1)
            counts = merged[part]
            counts[place] = np.minimum(counts[place] + 1 + (got & np.uint32(1)).astype(np.uint8), 2)
    for part, counts in merged.items():
        yield pa.record_batch(
            [pa.array([part], pa.int64()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())],
            names=["slice", "bits"],
        )


def merged_sketch(texts: DataFrame, window: int, bits: int) -> np.ndarray:
    """SKETCH_ROWS bitmaps of 2^bits cells: count at least two."""
    spark = texts.sparkSession
    partial = texts.select("text").mapInArrow(_sketch(window, bits), "slice long, cells binary")
    merged = partial.repartition(shuffle_partitions(spark), "slice").mapInArrow(_merge, "slice long, bits binary")
    out = np.zeros((SKETCH_ROWS, 1 << bits - 3), np.uint8)
    width = 1 << SLICE_BITS - 3
    for row in merged.toLocalIterator():
        part, r = divmod(row["slice"], SKETCH_ROWS)
        out[r, part * width : (part + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def repeated_bits(sketch: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for row in range(SKETCH_ROWS):
        cell = cells(keys, row, bits)
        out &= sketch[row][(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


SUSPECTS = "owner int, t1 long, t2 long, runs array<int>, entries binary, docs binary"
ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<u4"), ("at", "<u4")])
KNOWN = np.uint32(0xFFFFFFFF)


def _suspects(window: int, bits: int, owners: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = sketch.value
        for chunk in _chunks(batches):
            yield from suspects(chunk, bitmaps)

    def suspects(chunk: pa.RecordBatch, bitmaps) -> Iterator[pa.RecordBatch]:
        ids = np.stack([chunk.column(1).to_numpy(), chunk.column(2).to_numpy()], axis=1)
        _, first, copies = np.unique(ids, axis=0, return_index=True, return_counts=True)
        order = np.argsort(first)  # equal texts are handled once
        first, copies = first[order], copies[order]
        ids = ids[first]
        words = Words(chunk.column(0).take(pa.array(first)))
        where, keys, _ = anchors(words, window)
        if not len(where):
            return
        keep = repeated_bits(bitmaps, keys, bits)
        doc = np.searchsorted(words.bounds, where, side="right") - 1
        keep |= copies[doc] > 1
        where, doc = where[keep], doc[keep]
        if not len(where):
            return
        at = where - words.bounds[doc]
        a, b = (rolling(words.words[i], window, BASE[i])[where] for i in (0, 1))
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        known = np.bincount(group, weights=copies[doc])[group] > 1
        lead = np.zeros(len(order), bool)
        lead[order[new]] = True
        entries = np.empty(int(lead.sum()), ENTRY)
        entries["a"], entries["b"], entries["at"] = a[lead], b[lead], at[lead]
        entries["doc"] = np.where(known[lead], KNOWN, doc[lead].astype(np.uint32))
        # places known here: runs of consecutive window starts, for each text
        place, of = where[known], doc[known]
        if len(place):
            cut = np.ones(len(place), bool)
            cut[1:] = (np.diff(place) != 1) | (np.diff(of) != 0)
            begin = np.flatnonzero(cut)
            end = np.append(begin[1:], len(place)) - 1
            pairs = np.empty(2 * len(begin), np.int32)
            base = words.bounds[of[begin]]
            pairs[::2], pairs[1::2] = place[begin] - base, place[end] - base
            texts, start = np.unique(of[begin], return_index=True)
            m = len(texts)
            yield pa.record_batch(
                [
                    pa.array((ids[texts, 0] % owners).astype(np.int32)),
                    pa.array(ids[texts, 0]),
                    pa.array(ids[texts, 1]),
                    pa.ListArray.from_arrays(
                        pa.array(np.append(2 * start, len(pairs)).astype(np.int32)), pa.array(pairs)
                    ),
                    pa.nulls(m, pa.binary()),
                    pa.nulls(m, pa.binary()),
                ],
                names=["owner", "t1", "t2", "runs", "entries", "docs"],
            )
        owner = (scramble(entries["a"], MIX[1]) % np.uint64(owners)).astype(np.int32)
        order = np.argsort(owner, kind="stable")
        entries, owner = entries[order], owner[order]
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        packed, tables = [], []
        for part in np.split(entries, cuts[1:]):
            sent = part["doc"] != KNOWN
            used, short = np.unique(part["doc"][sent], return_inverse=True)
            part["doc"][sent] = short
            # column by column, for the shuffle's compression
            packed.append(b"".join(part[x].tobytes() for x in ENTRY.names))
            tables.append(ids[used].tobytes())
        m = len(cuts)
        yield pa.record_batch(
            [
                pa.array(owner[cuts]),
                pa.nulls(m, pa.int64()),
                pa.nulls(m, pa.int64()),
                pa.nulls(m, pa.list_(pa.int32())),
                pa.array(packed, pa.binary()),
                pa.array(tables, pa.binary()),
            ],
            names=["owner", "t1", "t2", "runs", "entries", "docs"],
        )

    return run


ANSWERS = "owner int, t1 long, t2 long, runs array<int>, docs binary, sizes binary, at binary"
FOUND = "t1 long, t2 long, runs array<int>, at array<int>"


def _group(owners: int):
    """Exact grouping of one owner's suspects; the answers are packed by the owner of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, tables, held = [], [], 0
        for batch in batches:
            own = batch.filter(pc.is_valid(batch.column("t1")))
            if own.num_rows:  # places known already go on as they are
                none = pa.nulls(own.num_rows, pa.binary())
                cols = [own.column(x) for x in ("owner", "t1", "t2", "runs")]
                yield pa.record_batch([*cols, none, none, none], names=NAMES)
            for packed, table in zip(batch.column("entries").to_pylist(), batch.column("docs").to_pylist()):
                if packed is None:
                    continue
                n = len(packed) // ENTRY.itemsize
                part, start = np.empty(n, ENTRY), 0
                for x in ENTRY.names:
                    size = n * ENTRY[x].itemsize
                    part[x] = np.frombuffer(packed[start : start + size], ENTRY[x])
                    start += size
                sent = part["doc"] != KNOWN
                part["doc"][sent] += np.uint32(held)
                held += len(table) // 16
                parts.append(part)
                tables.append(np.frombuffer(table, np.int64).reshape(-1, 2))
        if not parts:
            return
        entries, ids = np.concatenate(parts), np.concatenate(tables)
        parts.clear()
        entries = entries[np.lexsort((entries["b"], entries["a"]))]
        new = np.ones(len(entries), bool)
        new[1:] = (entries["a"][1:] != entries["a"][:-1]) | (entries["b"][1:] != entries["b"][:-1])
        sizes = np.diff(np.append(np.flatnonzero(new), len(entries)))
        hit = np.repeat(sizes > 1, sizes) & (entries["doc"] != KNOWN)
        found = entries[["doc", "at"]][hit]
        if not len(found):
            return
        text, back = np.unique(ids[found["doc"]], axis=0, return_inverse=True)
        to = text[:, 0] % owners
        order = np.lexsort((found["at"], back, to[back]))
        at, sizes = found["at"][order], np.bincount(back, minlength=len(text)).astype(np.uint32)
        order = np.argsort(to, kind="stable")
        text, sizes, to = text[order], sizes[order], to[order]
        cuts = np.flatnonzero(np.diff(to, prepend=-1))
        ends = np.append(0, np.cumsum(sizes, dtype=np.int64))[cuts]
        m = len(cuts)
        yield pa.record_batch(
            [
                pa.array(to[cuts].astype(np.int32)),
                pa.nulls(m, pa.int64()),
                pa.nulls(m, pa.int64()),
                pa.nulls(m, pa.list_(pa.int32())),
                pa.array([x.tobytes() for x in np.split(text, cuts[1:])], pa.binary()),
                pa.array([x.tobytes() for x in np.split(sizes, cuts[1:])], pa.binary()),
                pa.array([x.tobytes() for x in np.split(at, ends[1:])], pa.binary()),
            ],
            names=NAMES,
        )

    return run


NAMES = ["owner", "t1", "t2", "runs", "docs", "sizes", "at"]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of this owner: known runs, and places of repeated windows."""
    known: dict[tuple[int, int], list] = {}
    tables, sizes, places = [], [], []
    for batch in batches:
        for t1, t2, runs, docs, size, at in zip(*(batch.column(x).to_pylist() for x in NAMES[1:])):
            if docs is None:
                known.setdefault((t1, t2), []).append(runs)
            else:
                tables.append(np.frombuffer(docs, np.int64).reshape(-1, 2))
                sizes.append(np.frombuffer(size, np.uint32))
                places.append(np.frombuffer(at, np.uint32))
    if known:
        tables.append(np.array(list(known), np.int64))
        sizes.append(np.zeros(len(known), np.uint32))
    if not tables:
        return
    text, back = np.unique(np.concatenate(tables), axis=0, return_inverse=True)
    size = np.concatenate(sizes).astype(np.int64)
    of = np.repeat(back, size)
    at = np.concatenate(places)[np.argsort(of, kind="stable")].astype(np.int32) if places else np.zeros(0, np.int32)
    offsets = np.append(0, np.cumsum(np.bincount(of, minlength=len(text)))).astype(np.int32)
    runs = [list({tuple(r) for r in known.get(t, ())}) for t in map(tuple, text.tolist())]
    yield pa.record_batch(
        [
            pa.array(text[:, 0]),
            pa.array(text[:, 1]),
            pa.array([[x for r in own for x in r] for own in runs], pa.list_(pa.int32())),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(at)),
        ],
        names=["t1", "t2", "runs", "at"],
    )


def _remove(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column("text").cast(pa.binary())
            for raw, runs, at in zip(texts, batch.column("runs"), batch.column("at")):
                words = (raw.as_py() or b"").split()
                total = len(words)
                if at.is_valid:
                    change = np.zeros(total + 1, np.int64)
                    place, pairs = at.values.to_numpy(), runs.values.to_numpy()
                    np.add.at(change, place, 1)
                    np.add.at(change, place + window, -1)
                    np.add.at(change, pairs[::2], 1)
                    np.add.at(change, pairs[1::2] + window, -1)
                    clean = (np.cumsum(change[:total]) == 0).tolist()
                    words = [w for w, c in zip(words, clean) if c]
                kept = b" ".join(words)
                out.append((total, total - len(words), hashlib.sha256(kept).hexdigest() if digest else kept))
            last = pa.array([x[2] for x in out], pa.string() if digest else pa.binary())
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    last if digest else last.cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"],
            )

    return run


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, digest: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_removed, and the kept words joined by a space (kept), or with digest
    their kept_sha256."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.selectExpr("doc_id", *KEYED)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(SKETCH_BITS_CAP, max(SLICE_BITS, (size // 8).bit_length()))
    sketch = spark.sparkContext.broadcast(merged_sketch(rows, window, bits))  # at most 64 MB
    owners = shuffle_partitions(spark)
    sent = rows.select("text", "t1", "t2").mapInArrow(_suspects(window, bits, owners, sketch), SUSPECTS)
    answers = sent.repartitionById(owners, "owner").mapInArrow(_group(owners), ANSWERS)
    found = answers.repartitionById(owners, "owner").mapInArrow(_assemble, FOUND)
    return rows.join(found, ["t1", "t2"], "left").select("doc_id", "text", "runs", "at").mapInArrow(
        _remove(window, digest),
        f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string",
    )

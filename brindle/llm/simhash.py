"""SimHash near-duplicate detection with BK-trees.

Fingerprints: each word shingle's XXH64 votes on 64 bits.  Equal fingerprints are merged before
anything else.  Distinct fingerprints are cut into blocks; two that differ in at most `radius`
bits agree on all the bits of some choice of `blocks - radius` blocks, so every choice and value
names a shard, and each linked pair meets in some shard.  In each shard a BK-tree is built
(children keyed by integer Hamming distance to their parent) and searched along the edges within
the radius.  Trees travel with their shard, not to every executor: their total size grows with
the data, so they are dealt out and not broadcast; a shard that many similar texts share is cut
into parts, searched pair by pair.  A shard returns at most one edge per member
(its local root), never its pairs; the star algorithm joins the shards' edges.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle; a null doc_id takes part but names no component unless
all its members have none; repeated rows give repeated results; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, owners_for, portions, shuffle_partitions, spread_join, temporary, utf8, without_rows, written
from .components import components
from .substring_dedup import BASE, MIX, Words, rolling, scramble

SEED = 42
FRONTIER = 1 << 20
VOTES = 1 << 17
SHARD_ROWS = 1 << 13
#: Rows of shards that one task searches.
TASK_NODES = 1 << 20
#: Near copies: similarity of five-word shingle sets; texts of one shingle that meet in one task.
SIMILARITY, CELL_ROWS = 0.8, 1 << 12
#: A shingle's place in a text, whether it is hot, and its cell share a long.
AT_BITS, CELL_SHIFT = 32, 33
#: Texts sampled at least, and shingles kept at most, to put common shingles last.
COMMON_SAMPLE, COMMON_MOST = 1 << 13, 1 << 18
#: Logarithms of the least and most parity bits kept of a text, and pairs compared at once.
LEAST_BITS, MOST_BITS = 9, 16
#: Bytes of a sketch at its coarsest.
COARSE = 1 << LEAST_BITS - 3
PAIRS = 1 << 18
#: Cells to search again, and texts to look up, that are broadcast.
FEW = 1 << 18
#: Each round of search gives out so many times more forests of a cell than the one before.
DEEPER = 16


def shingles(raw: bytes, words: int) -> list[bytes]:
    """Shingles of `words` lower-cased words, repeats included; the whole sequence if shorter."""
    parts = raw.lower().split()
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    text = b" ".join(parts)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=starts[1:])
    return [text[a:b] for a, b in zip(starts[: -words].tolist(), (starts[words:] - 1).tolist())]


def vote(hashes: np.ndarray, sizes) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes (sizes may be 0)."""
    out = np.zeros(len(sizes), np.uint64)
    sizes = np.asarray(sizes)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.cumsum(sizes[full]) - sizes[full]
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > sizes[full][:, None], axis=1)
        out[full] = packed.view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            prints, hashes, sizes = [], [], []
            for raw in utf8(batch.column(1)):
                own = [digest(x, SEED) for x in shingles(raw, words)]
                hashes += own
                sizes.append(len(own))
                if len(hashes) >= VOTES:
                    prints.append(vote(np.array(hashes, np.uint64), sizes))
                    hashes, sizes = [], []
            prints.append(vote(np.array(hashes, np.uint64), sizes))
            yield pa.record_batch(
                [batch.column(0), pa.array(np.concatenate(prints).view(np.int64))], names=["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_fingerprints(words), "doc_id long, fp long")


def block_masks(radius: int, count: int) -> list[int]:
    """Masks of every choice of blocks that must agree.  More distinct fingerprints call for more
    selective choices: about 4096 fingerprints a shard if bits were random."""
    blocks = radius + 1
    while count >> (64 * (blocks - radius) // blocks) > 4096:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(each, blocks - radius)]


def build_forest(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of all groups at once (group: 0.., sorted).  Returns each element's parent (-1 for
    a root: the group's first) and the distance to it.  Element order is insertion order."""
    n = len(fps)
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    root = np.searchsorted(group, group)
    live = np.flatnonzero(root != np.arange(n))
    at = root[live]
    while len(live):
        d = np.bitwise_count(fps[live] ^ fps[at]).astype(np.int64)
        slot = at * 65 + d
        _, first, back = np.unique(slot, return_index=True, return_inverse=True)
        child = live[first][back]  # the earliest element becomes the child, the others descend to it
        new = child == live
        parent[live[new]], edge[live[new]] = at[new], d[new]
        live, at = live[~new], child[~new]
    return parent, edge


def search_forest(fps, group, parent, edge, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j), j inserted before i, with distance at most radius, in bounded portions."""
    n = len(fps)
    nodes = np.flatnonzero(parent >= 0)
    nodes = nodes[np.argsort(parent[nodes] * 65 + edge[nodes])]
    slots = parent[nodes] * 65 + edge[nodes]
    root = np.searchsorted(group, group)
    todo = [(np.arange(n), root)]
    while todo:
        query, node = todo.pop()
        if len(query) > FRONTIER:
            half = len(query) // 2
            todo += [(query[half:], node[half:]), (query[:half], node[:half])]
            continue
        d = np.bitwise_count(fps[query] ^ fps[node]).astype(np.int64)
        hit = (d <= radius) & (node < query)
        if hit.any():
            yield query[hit], node[hit]
        low = np.searchsorted(slots, node * 65 + np.maximum(d - radius, 0))
        high = np.searchsorted(slots, node * 65 + np.minimum(d + radius, 64), side="right")
        fan = high - low
        keep = fan > 0
        query, low, fan = query[keep], low[keep], fan[keep]
        while len(query):  # expand in portions of bounded size
            take = max(1, int(np.searchsorted(np.cumsum(fan), FRONTIER, side="right")))
            sizes = fan[:take]
            ends = np.cumsum(sizes)
            child = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(low[:take], sizes)
            nxt, asked = nodes[child], np.repeat(query[:take], sizes)
            # elements inserted after the query can't be linked to it, nor can their subtrees
            older = nxt < asked
            if older.any():
                todo.append((asked[older], nxt[older]))
            query, low, fan = query[take:], low[take:], fan[take:]


def local_roots(n: int, links) -> np.ndarray:
    """Least element of each local component."""
    up = np.arange(n)

    def find(x):
        while True:
            y = up[x]
            if (up[y] == y).all():
                return y
            up[x] = up[y]
            x = y

    for a, b in links:
        while True:
            ra, rb = find(a), find(b)
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
    return find(np.arange(n)) if n else up


def first_neighbours(n: int, links) -> np.ndarray:
    """The earliest element linked to each one directly; itself without one."""
    out = np.arange(n)
    for a, b in links:
        np.minimum.at(out, a, b)
    return out


def _shard_links(radius: int, reduce=local_roots):
    """All shards of one partition: rows mask, value, pair, fp and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if not got:
            return
        mask, value, pair, fps, nodes = (np.concatenate([x.column(i).to_numpy() for x in got]) for i in range(5))
        order = np.lexsort((nodes, fps, pair, value, mask))
        mask, value, pair, nodes = mask[order], value[order], pair[order], nodes[order]
        fps = fps[order].view(np.uint64)
        new = np.ones(len(fps), bool)
        new[1:] = (np.diff(mask) != 0) | (value[1:] != value[:-1]) | (np.diff(pair) != 0)
        group = np.cumsum(new) - 1
        parent, edge = build_forest(fps, group)
        to = reduce(len(fps), search_forest(fps, group, parent, edge, radius))
        linked = np.flatnonzero(to != np.arange(len(fps)))
        yield pa.record_batch([pa.array(nodes[linked]), pa.array(nodes[to[linked]])], names=["a", "b"])

    return run


def shard_edges(nodes: DataFrame, radius: int, limit: int = SHARD_ROWS, reduce=local_roots) -> DataFrame:
    """nodes(fp, node) -> a, b: a forest of the links in each shard.

    A shard of more than `limit` nodes is cut into parts, and each pair of parts is a shard of its
    own, so a task never holds more than two parts of one."""
    spark = nodes.sparkSession
    count = nodes.count()
    masks = block_masks(radius, count)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "value")
    shards = nodes.select("fp", "node", dealt)
    large = written(
        shards.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit), "large-shards"
    )
    if large.isEmpty():
        shards = shards.withColumn("pair", F.lit(0))
    else:
        large = large.withColumn("parts", F.ceil(F.col("n") / limit).cast("int"))
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        pair = F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least("part", x) * F.col("parts") + F.greatest("part", x)
        )
        shards = (
            spread_join(shards, large, ["mask", "value"], "n", ["node"])
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("part", part)
            .withColumn("pair", F.explode(pair))
        )
    return (
        shards.select("mask", "value", "pair", "fp", "node")
        .repartition(owners_for(spark, count * len(masks), TASK_NODES), "mask", "value", "pair")
        .mapInArrow(_shard_links(radius, reduce), "a long, b long")
    )


def fingerprint_components(prints: DataFrame, radius: int = 4, limit: int = SHARD_ROWS) -> DataFrame:
    """prints(doc_id, fp) -> fp, component_id and n (rows) for each distinct fingerprint."""
    with temporary(prints.sparkSession):
        distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "prints")
        roots = components(shard_edges(distinct.select("fp", F.col("fp").alias("node")), radius, limit))
        of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
            "fp", "low", "n", F.coalesce("root", "fp").alias("root")
        )
        of = written(of, "print-roots")
        lows = written(of.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("prints")), "roots")
        placed = spread_join(of, lows, ["root"], "prints", ["fp"], "inner")
        return written(placed.select("fp", "component_id", "n"), "print-components", keep=True)


def near_duplicates(
    docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    found = fingerprint_components(prints, radius)
    return spread_join(prints, found, ["fp"], "n", ["doc_id"], "inner").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the `words`-word shingles of each text, sorted, one text after
    another, and the size of each set; the whole sequence of a shorter text is one shingle."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    n = len(texts)
    own = Words(texts)
    bounds, hashes = own.bounds, own.words[0]
    size = np.diff(bounds)
    where = np.flatnonzero(own.starts(words))
    values = scramble(rolling(hashes, words, BASE[0]), MIX[0])[where] if len(where) else np.zeros(0, np.uint64)
    doc = np.searchsorted(bounds, where, side="right") - 1
    short = np.flatnonzero((size > 0) & (size < words))
    rest = [scramble(rolling(hashes[bounds[i] : bounds[i + 1]], int(size[i]), BASE[0]), MIX[0])[0] for i in short]
    doc, values = np.concatenate([doc, short]).astype(np.int64), np.concatenate([values, np.array(rest, np.uint64)])
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return values[new], np.bincount(doc[new], minlength=n)


def _all_shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 0)):
            values, sizes = _sets(batch.column(0), words)
            every = np.concatenate([values, np.zeros((sizes == 0).sum(), np.uint64)])
            yield pa.record_batch([pa.array(every.view(np.int64))], names=["token"])

    return run


def _common(source: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that many texts share, and their estimated counts, from a sample
    of texts.  They fix the order in which prefixes are taken and how finely a shingle's texts are
    dealt out: any order and any dealing finds every pair."""
    count = source.count()
    share = max(1, min(count // COMMON_SAMPLE, 24))
    sample = source.where(F.pmod(F.xxhash64("uid"), F.lit(share)) == 0).select("text")
    found = (
        sample.mapInArrow(_all_shingles(words), "token long")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 2")
        .orderBy(F.desc("n"), "token")
        .limit(COMMON_MOST)
        .toArrow()
    )
    tokens, n = found["token"].to_numpy().view(np.uint64), found["n"].to_numpy() * share
    order = np.argsort(tokens)
    return tokens[order], n[order]


def parity_sketches(values: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each text the parities of its values in 2 to 4 buckets a value (a power of two).  The
    parities in which two sets differ are at most as many as the values in which they do."""
    wide = np.clip(np.ceil(np.log2(2 * np.maximum(sizes, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    ends = np.append(0, np.cumsum(1 << wide))
    place = ends[doc] + (values & ((np.uint64(1) << wide.astype(np.uint64)) - np.uint64(1))[doc]).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(ends[-1])) & 1).astype(np.uint8)).tobytes()
    return [packed[a:b] for a, b in zip((ends[:-1] >> 3).tolist(), (ends[1:] >> 3).tolist())]


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch brought down to `size` bytes: the parities of its halves are added."""
    words = np.frombuffer(sketch, np.uint64)
    while 8 * len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def parities_apart(sketches: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many parities the sketches of each pair differ, at the coarser one's resolution."""
    length = np.array([len(x) for x in sketches])
    size, out = np.minimum(length[a], length[b]), np.zeros(len(a), np.int64)
    for width in np.unique(size):
        some = np.flatnonzero(size == width)
        for part in np.array_split(some, len(some) * int(width) // (1 << 25) + 1):
            used, back = np.unique(np.concatenate([a[part], b[part]]), return_inverse=True)
            rows = np.stack([folded(sketches[x], int(width)) for x in used])
            m = len(part)
            out[part] = np.bitwise_count(rows[back[:m]] ^ rows[back[m:]]).sum(axis=1)
    return out


def _prefixes(words: int, ratio: Fraction, common: tuple[np.ndarray, np.ndarray], cell_rows: int):
    """What is kept of each text: the size of its shingle set, its SimHash, parities whole and
    folded, the shingles of its prefix, and for each into how many cells the shingle's texts are dealt."""
    known, often = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 2)):
            values, sizes = _sets(batch.column(2), words)
            n = len(sizes)
            doc = np.repeat(np.arange(n), sizes)
            sketches = parity_sketches(values, doc, sizes)
            # wordless texts have one shingle of their own, zero
            empty = np.flatnonzero(sizes == 0)
            doc, values = np.concatenate([doc, empty]), np.concatenate([values, np.zeros(len(empty), np.uint64)])
            rank = np.zeros(len(values), np.int64)
            if len(known) and len(values):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                rank = np.where(known[at] == values, often[at], 0)
            order = np.lexsort((values, rank, doc))
            # a partner shares at least ceil(ratio * size): one of the others, and one more, is common
            long = sizes + (-ratio.numerator * sizes // ratio.denominator) + 1
            full = np.maximum(sizes, 1)
            starts = np.cumsum(full) - full
            taken = order[np.arange(len(values)) - starts[doc[order]] < long[doc[order]]]
            ends = pa.array(np.append(0, np.cumsum(long)).astype(np.int32))
            cells = (rank[taken] // cell_rows + 1).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (values[taken].view(np.int64), cells)]
            prints = vote(values[np.argsort(doc, kind="stable")], full)
            coarse = [folded(x, COARSE).tobytes() for x in sketches]
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(prints.view(np.int64)),
                    pa.array(sketches, pa.binary()),
                    pa.array(coarse, pa.binary()),
                    *lists,
                ],
                names=["uid", "doc_id", "size", "fp", "sketch", "coarse", "tokens", "cells"],
            )

    return run


def _centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows token, place (cell, whether hot, at), uid in that order -> those whose cell has two texts
    or more, or whose token is hot, with the cell's first text as its centre.  Rows stream through."""
    names = ["token", "uid", "at", "centre", "hot"]
    last, centre, held = None, 0, None  # cell of the last row, its centre, its only row so far
    for batch in batches:
        if not batch.num_rows:
            continue
        token, place, uid = (batch.column(i).to_numpy() for i in range(3))
        cell, hot, at = place >> CELL_SHIFT, (place >> AT_BITS & 1).astype(bool), (place & ((1 << AT_BITS) - 1)).astype(np.int32)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
        new[0] = (token[0], cell[0]) != last
        group = np.cumsum(new)  # 0: the last cell goes on
        starts = np.flatnonzero(new)
        own = np.append(centre, uid[starts])[group]
        size = np.bincount(group, minlength=int(group[-1]) + 1)
        if not new[0]:
            size[0] += 2  # it has a row already
            if held is not None:
                yield pa.record_batch([pa.array([x]) for x in held], names=names)
        held = None
        keep = (size[group] > 1) | hot
        if not keep[-1]:
            held = (token[-1], uid[-1], at[-1], uid[-1], False)
        last, centre = (token[-1], cell[-1]), own[-1]
        yield pa.record_batch([pa.array(x[keep]) for x in (token, uid, at, own, hot)], names=names)


def _close(ratio: Fraction):
    """Rows a, b, their sizes (alike enough) and sketches -> the pairs that may be similar enough."""
    n, d = ratio.numerator, ratio.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            rows = np.arange(batch.num_rows)
            sketches = batch.column(4).to_pylist() + batch.column(5).to_pylist()
            may = (n + d) * parities_apart(sketches, rows, rows + batch.num_rows) <= (d - n) * (one + two)
            yield pa.record_batch([batch.column(i).filter(pa.array(may)) for i in (0, 1)], names=["a", "b"])

    return run


PLACE = "token long, pair int, size long, part int, parts int, uid long, at int, root long"
CELL = f"{PLACE}, sketch binary, failed array<long>"


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of token and pair, in tables that cut no cell (token, pair)."""
    held = None
    for batch in batches:
        got = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        token, pair = (got.column(i).to_numpy() for i in (0, 1))
        cuts = np.flatnonzero((token[1:] != token[:-1]) | (pair[1:] != pair[:-1])) + 1
        whole = int(cuts[-1]) if len(cuts) else 0  # the last cell may go on in the next batch
        if whole:
            yield got.slice(0, whole)
        held = got.slice(whole)
    if held is not None and held.num_rows:
        yield held


def _possible_pairs(cells: pa.Table, ratio: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of one cell, in order of size, that aren't connected and can be similar enough by
    size and position; in bounded portions."""
    n, d = ratio.numerator, ratio.denominator
    token, pair, size, part, parts, _, at, root = (cells.column(i).to_numpy() for i in range(8))
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (pair[1:] != pair[:-1])
    cell = np.cumsum(new)
    last = np.searchsorted(cell << 40 | size, cell << 40 | np.minimum(size * d // n, (1 << 40) - 1), side="right")
    fan = np.maximum(last - np.arange(len(token)) - 1, 0)
    ends = np.cumsum(fan)
    low = 0
    while low < len(fan):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, side="right")))
        own = fan[low:high]
        i = np.repeat(np.arange(low, high), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        low = high
        # two texts of one part meet once, in the cell of that part alone
        may = (root[i] != root[j]) & ((part[i] != part[j]) | (pair[i] == part[i] * parts[i] + part[i]))
        may &= (n + d) * np.minimum(size[i] - at[i], size[j] - at[j]) >= n * (size[i] + size[j])
        yield i[may], j[may]


def _coarsely_close(bits: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, ratio: Fraction) -> np.ndarray:
    """Whether the pairs may be similar enough by their folded parities (rows of bits)."""
    n, d = ratio.numerator, ratio.denominator
    return (n + d) * np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= (d - n) * (size[i] + size[j])


def _partnered(ratio: Fraction):
    """Rows PLACE and coarse in order of token, pair and size -> PLACE of those with a possible
    partner in their cell by size, position and folded parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _whole_cells(batches):
            some, size = np.zeros(cells.num_rows, bool), cells.column(2).to_numpy()
            bits = np.frombuffer(b"".join(cells.column(8).to_pylist()), np.uint64).reshape(-1, COARSE // 8)
            for i, j in _possible_pairs(cells, ratio):
                may = _coarsely_close(bits, size, i, j, ratio)
                some[i[may]] = some[j[may]] = True
            yield from cells.select(range(8)).filter(pa.array(some)).to_batches()

    return run


def _forests(ratio: Fraction, depth: int):
    """Rows CELL in order of token, pair and size -> token, pair, a, b, more: of the pairs in each cell
    (token, pair) that may be similar enough and aren't connected, `depth` forests, likeliest first, and
    whether the cell has pairs beyond them."""
    n, d = ratio.numerator, ratio.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in _whole_cells(batches):
            yield found(cells)

    def found(cells: pa.Table) -> pa.RecordBatch:
        token, pair, size, _, _, uid, _, root = (cells.column(i).to_numpy() for i in range(8))
        sketches, failed = cells.column(8).to_pylist(), cells.column(9).to_pylist()
        # classes: rows of a cell that are connected already
        _, of = np.unique(np.stack([token, pair, root], axis=1), axis=0, return_inverse=True)
        _, cell = np.unique(np.stack([token, pair], axis=1), axis=0, return_inverse=True)
        forests: list[dict[int, int]] = [{} for _ in range(depth)]

        def find(up, x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        def joins(x, y) -> bool:
            for up in forests:
                x_, y_ = find(up, x), find(up, y)
                if x_ != y_:
                    up[x_] = y_
                    return True
            return False

        bits = np.stack([folded(x, COARSE) for x in sketches])
        out, beyond = [], set()
        for i, j in _possible_pairs(cells, ratio):
            may = _coarsely_close(bits, size, i, j, ratio)
            i, j = i[may], j[may]
            most = (d - n) * (size[i] + size[j])
            apart = (n + d) * parities_apart(sketches, i, j)
            may = apart <= most
            i, j, share = i[may], j[may], apart[may] / np.maximum(most[may], 1)
            for k in np.argsort(share, kind="stable").tolist():
                if uid[j[k]] in (failed[i[k]] or ()):
                    continue
                if joins(int(of[i[k]]), int(of[j[k]])):
                    out.append((i[k], j[k]))
                else:
                    beyond.add(int(cell[i[k]]))
        i, j = (np.array([x[k] for x in out], np.int64) for k in (0, 1))
        ends = np.sort(np.stack([uid[i], uid[j]], axis=1), axis=1)
        more = np.isin(cell[i], list(beyond))
        cols = [pa.array(x) for x in (token[i], pair[i], ends[:, 0], ends[:, 1], more)]
        return pa.record_batch(cols, names=["token", "pair", "a", "b", "more"])

    return run


def _alike(words: int, ratio: Fraction):
    """Rows a, b and their texts -> the pairs whose whole shingle sets are similar enough."""
    n, d = ratio.numerator, ratio.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 2)):
            (left, sizes), (right, others) = (_sets(batch.column(i), words) for i in (2, 3))
            rows = np.arange(batch.num_rows)
            pair = np.concatenate([np.repeat(rows, sizes), np.repeat(rows, others)])
            value = np.concatenate([left, right])
            order = np.lexsort((value, pair))
            pair, value = pair[order], value[order]
            twin = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
            common = np.bincount(pair[1:][twin], minlength=batch.num_rows)
            keep = pa.array((n + d) * common >= n * (sizes + others))
            yield pa.record_batch([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return run


class _NearCopies:
    """The rows of source(uid, doc_id, text) linked by a similarity of shingle sets.

    Two sets of similarity t have a common shingle among the first (1 - t) * size + 1 of each, in any
    one order of shingles; common ones come last.  A first round proposes a bounded number of partners
    for each text: a SimHash neighbour from the BK-trees, a text with the same SimHash, and the text
    with the fewest rarer shingles among those that share a shingle.  Further rounds look at the texts
    that share a shingle and aren't connected yet: a cell compares them by size, position and
    parities, none of which can lose a pair, and gives out a forest of what is left, so at most
    one pair for each text.  Pairs are decided on the whole sets; a cell whose pairs all held, or that
    has no others, is done, and the rest are searched again without the pairs that failed, for
    DEEPER times as many forests each time, until none is left."""

    def __init__(self, source: DataFrame, words: int, ratio: Fraction, radius: int, cell_rows: int):
        self.spark, self.source, self.words, self.ratio, self.radius = source.sparkSession, source, words, ratio, radius
        self.cell_rows = cell_rows
        shape = "uid long, doc_id long, size long, fp long, sketch binary, coarse binary, tokens array<long>, cells array<int>"
        found = source.mapInArrow(_prefixes(words, ratio, _common(source, words), cell_rows), shape)
        self.prints = written(found, "copy-prints")

    def shared(self) -> DataFrame:
        """token, uid, at, centre, hot of prefix shingles that several texts have."""
        dealt = self.prints.select("uid", F.posexplode(F.arrays_zip("tokens", "cells")).alias("at", "t"))
        cell = F.pmod(F.xxhash64("uid"), F.col("t.cells"))
        hot = (F.col("t.cells") > 1).cast("long")
        place = F.shiftleft(cell, CELL_SHIFT) + F.shiftleft(hot, AT_BITS) + F.col("at")
        dealt = dealt.select(F.col("t.tokens").alias("token"), place.alias("place"), "uid")
        cells = dealt.repartition(shuffle_partitions(self.spark), "token", F.shiftright("place", CELL_SHIFT))
        cells = cells.sortWithinPartitions("token", "place", "uid")
        return written(cells.mapInArrow(_centred, "token long, uid long, at int, centre long, hot boolean"), "copy-shared")

    def tries(self, shared: DataFrame) -> DataFrame:
        """Pairs a < b of the first round: a few for each text."""
        counted = shared.where("uid <> centre").groupBy("uid", "centre").agg(F.count(F.lit(1)).alias("n"))
        found = counted.groupBy("uid").agg(F.max(F.struct("n", "centre"))["centre"].alias("to"))
        # the centres of a hot shingle's cells among themselves
        centres = shared.where("hot and uid = centre").select("token", "at", "uid")
        hubs = centres.groupBy("token").agg(F.min(F.struct("at", "uid"))["uid"].alias("to"))
        found = found.union(centres.join(hubs, "token").select("uid", "to"))
        # equal SimHashes, in cells like shingles, and the BK-trees' direct neighbours
        prints = self.prints.select("uid", "fp")
        distinct = written(prints.groupBy("fp").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n")), "copy-fps")
        cells = F.ceil(F.col("n") / self.cell_rows).cast("int")
        many = distinct.where("n > 1").select("fp", "first", cells.alias("cells"), "n")
        twins = spread_join(prints, many, ["fp"], "n", ["uid"], "inner")
        twins = twins.withColumn("cell", F.pmod(F.xxhash64("uid"), F.col("cells")))
        heads = twins.groupBy("fp", "cell").agg(F.min("uid").alias("to"), F.min("first").alias("first"))
        found = found.union(twins.join(heads.drop("first"), ["fp", "cell"]).select("uid", "to"))
        found = found.union(heads.select(F.col("to").alias("uid"), F.col("first").alias("to")))
        near = shard_edges(distinct.select("fp", F.col("first").alias("node")), self.radius, reduce=first_neighbours)
        found = found.union(near.toDF("uid", "to"))
        ends = found.where("uid <> to").select(F.least("uid", "to").alias("a"), F.greatest("uid", "to").alias("b")).distinct()
        n, d = self.ratio.numerator, self.ratio.denominator
        one, two = (self.prints.select(F.col("uid").alias(x), F.col("size").alias(f"size_{x}")) for x in "ab")
        sized = ends.join(one, "a").join(two, "b")
        alike = F.least("size_a", "size_b") * F.lit(d) >= F.greatest("size_a", "size_b") * F.lit(n)
        sized = written(sized.where(alike), "copy-tries")
        known = self.sketches(sized.select(F.explode(F.array("a", "b")).alias("uid")))
        one, two = (known.select(F.col("uid").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        joined = sized.join(one, "a").join(two, "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
        return joined.mapInArrow(_close(self.ratio), "a long, b long")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole shingle sets are similar enough."""
        pairs = written(pairs, "copy-pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
        texts = written(self.source.join(wanted, "uid", "left_semi").select("uid", "text"), "copy-texts")
        one, two = (texts.select(F.col("uid").alias(x), F.col("text").alias(f"of_{x}")) for x in "ab")
        joined = pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b")
        return written(joined.mapInArrow(_alike(self.words, self.ratio), "a long, b long"), "copy-links")

    def unconnected(self, shared: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows CELL, without root and failed, of shingles whose texts aren't all connected."""
        placed = shared.select("token", "uid", "at").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
        mixed = mixed.where("low <> high").select("token", "n", F.ceil(F.col("n") / self.cell_rows).cast("int").alias("parts"))
        rows = spread_join(placed, written(mixed, "copy-mixed"), ["token"], "n", ["uid"], "inner")
        rows = rows.join(self.prints.select("uid", "size", "coarse"), "uid")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
        # texts of a shingle are cut into parts, every two of which meet in a cell of their own
        meet = "transform(sequence(0, parts - 1), q -> least(part, q) * parts + greatest(part, q))"
        rows = rows.withColumn("pair", F.explode(F.expr(meet)))
        cells = self.in_cells(rows.select("token", "pair", "size", "part", "parts", "uid", "at", "root", "coarse"))
        rows = written(cells.mapInArrow(_partnered(self.ratio), PLACE).drop("root"), "copy-places")
        return written(rows.join(self.sketches(rows.select("uid")), "uid"), "copy-rows")

    def sketches(self, wanted: DataFrame) -> DataFrame:
        """uid, sketch of the wanted rows; while these are few, the others' sketches aren't dealt out."""
        wanted = written(wanted.distinct(), "copy-wanted")
        if wanted.count() <= FEW:
            wanted = F.broadcast(wanted)
        return self.prints.join(wanted, "uid", "left_semi").select("uid", "sketch")

    def in_cells(self, rows: DataFrame) -> DataFrame:
        rows = rows.repartition(shuffle_partitions(self.spark), "token", "pair")
        return rows.sortWithinPartitions("token", "pair", "size")

    def search(self, rows: DataFrame, roots: DataFrame, failed: DataFrame, depth: int) -> DataFrame:
        """token, pair, a, b, more: the forests of all cells."""
        each = failed.union(failed.select("b", "a")).toDF("uid", "to").groupBy("uid").agg(F.collect_list("to").alias("failed"))
        cells = rows.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")).join(each, "uid", "left")
        cells = cells.select("token", "pair", "size", "part", "parts", "uid", "at", "root", "sketch", "failed")
        found = self.in_cells(cells).mapInArrow(_forests(self.ratio, depth), "token long, pair int, a long, b long, more boolean")
        return written(found, "copy-forests")

    def roots(self) -> DataFrame:
        """uid, root of all rows that are linked, but for the roots themselves."""
        shared = self.shared()
        links = self.confirmed(self.tries(shared))
        roots = components(links).toDF("uid", "root")
        rows = self.unconnected(shared, roots)
        failed, depth = links.limit(0), 1
        while not (forests := self.search(rows, roots, failed, depth)).isEmpty():
            pairs = forests.select("a", "b").distinct()
            good = self.confirmed(pairs)
            bad = written(pairs.join(good, ["a", "b"], "left_anti"), "copy-failed")
            if not good.isEmpty():  # the roots so far are links, too
                roots = components(roots.toDF("a", "b").union(good)).toDF("uid", "root")
            again = written(forests.where("more").join(bad, ["a", "b"]).select("token", "pair").distinct(), "copy-again")
            if not (cells := again.count()):
                break
            if cells <= FEW:
                again = F.broadcast(again)
            failed, depth = failed.union(bad), DEEPER * depth
            rows = written(rows.join(again, ["token", "pair"], "left_semi"), "copy-rows")
        return roots

    def dropped(self) -> DataFrame:
        """uid of the rows that have a linked row with a smaller id."""
        roots = self.roots()
        linked = roots.union(roots.select(F.col("root").alias("uid"), "root").distinct())
        placed = written(self.prints.select("uid", "doc_id").join(linked, "uid"), "copy-placed")
        me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
        first = written(placed.groupBy("root").agg(F.min(me)["uid"].alias("first"), F.count(F.lit(1)).alias("n")), "copy-firsts")
        return spread_join(placed, first, ["root"], "n", ["uid"], "inner").where("uid <> first").select("uid")


def drop_near_copies(
    docs: DataFrame,
    words: int = 5,
    similarity: float = SIMILARITY,
    radius: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The rows of docs without near copies: of each group linked by a Jaccard similarity of at
    least `similarity` between their five-word shingle sets the row with the smallest id stays.
    All columns stay.  SimHash and BK-trees propose pairs, a prefix filter those they miss; no pair
    is missed, and every pair is decided on the whole sets."""
    rows, uid = numbered(docs)
    source = rows.select(
        F.col(uid).alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    with temporary(docs.sparkSession):
        work = _NearCopies(source, words, Fraction(str(similarity)), radius, cell_rows)
        dropped = written(work.dropped(), "copy-drops", keep=True)
    return without_rows(rows, uid, dropped, docs)

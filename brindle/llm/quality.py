"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score = logistic(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): the pairwise
interactions cost linear time by the sum-of-squares identity.  Inputs are the distinct
lower-cased words of the whole text, hashed; statistics of its structure (word length, capitals,
symbols, digits, repetition, lines); and its size as metadata.  Labels, language, source and id
are never inputs.

Training uses at most TRAIN_ROWS labelled ids and TRAIN_FEATURES features of their texts (documented
bounds), those with the smallest hash of their id among the ones outside the held-out fold; the
fitted weights (about 2 MB) go to the tasks.  Every row is scored over its whole text.

Defined cases: null and empty texts get a score from their size alone; without labels of both
kinds every score is the share of good labels (0.5 without any); an id labelled both ways isn't
learnt from, and of texts with one id the one with the least hash is; repeated rows get equal scores;
a null id counts as held out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, temporary, written

WORD_BITS = 15
BINS = 24
STATS = 10
FEATURES = (1 << WORD_BITS) + STATS * BINS
RANK = 8
TRAIN_ROWS = 8192
TRAIN_FEATURES = 1 << 23
EPOCHS = 20
BATCH = 64
THRESHOLD = 0.3
FOLDS = 5


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def word_facts(word: bytes) -> tuple[int, int, int, int, int]:
    """Bucket of the lower-cased word, length, all capitals, symbols, digits."""
    text = word.decode("utf-8", "replace")
    letters = sum(c.isalpha() for c in text)
    digits = sum(c.isdigit() for c in text)
    return (
        xxhash.xxh64_intdigest(text.lower().encode()) >> (64 - WORD_BITS),
        len(text),
        int(letters > 1 and text.isupper()),
        len(text) - letters - digits,
        digits,
    )


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: bounds of each text's features, feature numbers, values."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    offsets = split.offsets.to_numpy()
    flat = split.values[int(offsets[0]) : int(offsets[-1])]
    full = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    bounds = seen[offsets - offsets[0]]
    coded = flat.filter(full).dictionary_encode()
    facts = np.array([word_facts(x) for x in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64).reshape(-1, 5)
    word = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    count = np.diff(bounds)
    some = np.maximum(count, 1)

    def total(values) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=n)

    own = facts[word] if len(word) else np.zeros((0, 5), np.int64)
    chars = np.maximum(total(own[:, 1]), 1)
    again = np.zeros(len(word), np.int64)
    if len(word) > 1:
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    pairs = np.unique(doc * (1 << 32) + word)
    distinct = np.bincount(pairs >> 32, minlength=n)
    lines = np.array(pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False), np.float64)
    size = np.array(pc.binary_length(texts).to_numpy(zero_copy_only=False), np.float64)
    shares = [
        np.log2(1 + count) / 20,
        np.log2(1 + size) / 28,
        np.minimum(chars / some / 16, 1),
        total(own[:, 2]) / some,
        total(own[:, 3]) / chars,
        total(own[:, 3] > 0) / some,
        total(own[:, 4]) / chars,
        distinct / some,
        total(again) / some,
        np.minimum(4 * lines / some, 1),
    ]
    stat = np.stack([np.minimum((s * BINS).astype(np.int64), BINS - 1) + k * BINS for k, s in enumerate(shares)], axis=1)
    buckets = np.unique((pairs >> 32) * (1 << WORD_BITS) + facts[pairs & 0xFFFFFFFF, 0] if len(pairs) else pairs)
    of, bucket = buckets >> WORD_BITS, buckets & ((1 << WORD_BITS) - 1)
    sizes = np.bincount(of, minlength=n)
    ends = np.cumsum(sizes + STATS)
    starts = ends - sizes - STATS
    ids = np.empty(int(ends[-1]) if n else 0, np.int64)
    values = np.empty(len(ids), np.float32)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of]
    ids[place], values[place] = bucket, (1 / np.sqrt(np.maximum(sizes, 1)))[of]
    tail = (ends - STATS)[:, None] + np.arange(STATS)
    ids[tail], values[tail] = (1 << WORD_BITS) + stat, 1.0
    return np.append(0, ends), ids, values


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, bias: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = bias
        self.w = np.zeros(FEATURES, np.float32)
        self.v = rng.normal(0, 0.05, (FEATURES, RANK)).astype(np.float32)

    def margins(self, bounds, ids, values) -> tuple[np.ndarray, np.ndarray]:
        starts = bounds[:-1]
        vx = self.v[ids] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        linear = np.add.reduceat(self.w[ids] * values, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, bounds, ids, values) -> np.ndarray:
        if len(bounds) < 2:
            return np.zeros(0)
        margin = self.margins(bounds, ids, values)[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def fit(self, bounds, ids, values, labels, rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> Machine:
        """Logistic loss by AdaGrad over shuffled mini-batches."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, RANK), 1e-2, np.float32), 1e-2
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for low in range(0, len(order), BATCH):
                rows = order[low : low + BATCH]
                sizes = bounds[rows + 1] - bounds[rows]
                ends = np.cumsum(sizes)
                take = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(bounds[rows], sizes)
                own, x = ids[take], values[take]
                margin, sums = self.margins(np.append(0, ends), own, x)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
                e = np.repeat(error, sizes).astype(np.float32) * x
                used, back = np.unique(own, return_inverse=True)
                dw = np.bincount(back, weights=e, minlength=len(used)) + decay * self.w[used] / len(rows)
                grad = e[:, None] * (np.repeat(sums, sizes, axis=0) - self.v[own] * x[:, None])
                dv = np.stack([np.bincount(back, weights=grad[:, k], minlength=len(used)) for k in range(RANK)], axis=1)
                dv += decay * self.v[used] / len(rows)
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += float(error.sum()) ** 2
                self.w[used] -= (rate * dw / np.sqrt(gw[used])).astype(np.float32)
                self.v[used] -= (rate * dv / np.sqrt(gv[used])).astype(np.float32)
                self.bias -= rate * float(error.sum()) / np.sqrt(gb)
        return self


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in portions(batch, 2):
            bounds, ids, values = features(part.column(2))
            at = pa.array(bounds.astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (ids.astype(np.int32), values)]
            yield pa.record_batch([part.column(0), part.column(1), *lists], names=["id", "label", "ids", "x"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bound: int = TRAIN_ROWS,
    features_bound: int = TRAIN_FEATURES,
):
    """A fitted machine, or the constant score where the labels are of one kind or none."""
    spark = docs.sparkSession
    labelled = labels.where(F.col("quality").isin(0, 1) & (fold(F.col(id_col)) != 0)).groupBy(F.col(id_col).cast("long").alias("__id"))
    sample = (
        labelled.agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("other"))
        .where("label = other")
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(bound)
        .select("__id", "label")
    )
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
    joined = rows.join(F.broadcast(sample), "__id")  # the sample has `bound` rows at most
    one = joined.groupBy("__id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    with temporary(spark):
        made = one.select("__id", "label", "text").mapInArrow(_extract, "id long, label int, ids array<int>, x array<float>")
        made = written(made, "training").withColumn("h", F.xxhash64("id"))
        sizes = made.select("h", "id", F.size("ids").alias("n")).toArrow()
        h, key = (sizes[x].to_numpy() for x in ("h", "id"))
        order = np.lexsort((key, h))
        last = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()[order]), features_bound, side="right"))
        if last < len(order):
            h, key = int(h[order[last]]), int(key[order[last]])
            made = made.where(f"h < {h} or (h = {h} and id < {key})")
        data = made.drop("h").toArrow().combine_chunks()
    label, key = data["label"].to_numpy().astype(np.float64), data["id"].to_numpy().copy()
    if len(label) == 0 or label.min() == label.max():
        return float(label.mean()) if len(label) else 0.5
    lists = data["ids"].combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    ids = lists.values.to_numpy().copy()
    values = data["x"].combine_chunks().values.to_numpy().copy()
    del data, lists
    pa.default_memory_pool().release_unused()
    order = np.argsort(key)  # rows in one order whatever the partitions
    sizes = np.diff(bounds)[order]
    ends = np.cumsum(sizes)
    take = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(bounds[order], sizes)
    share = label.mean()
    machine = Machine(float(np.log(share / (1 - share))))
    return machine.fit(np.append(0, ends), ids[take], values[take], label[order])


def _score(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                scores = machine.scores(*features(part.column(1))) if isinstance(machine, Machine) else np.full(part.num_rows, machine)
                yield pa.record_batch([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(machine), "doc_id long, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    return score(docs, train(docs, labels, **kw))


def _good(machine, threshold: float, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, place):
                scores = machine.scores(*features(part.column(place))) if isinstance(machine, Machine) else np.full(part.num_rows, machine)
                yield part.filter(pa.array(scores >= threshold))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier does not reject, all columns unchanged."""
    machine = train(docs, labels, text_col=text_col)
    return docs.mapInArrow(_good(machine, threshold, docs.columns.index(text_col)), docs.schema)

"""Benchmark decontamination by a broadcast hash set of n-grams (native).

Windows of 13 normalised words of every item (an item of fewer words is one window) make a hash
set.  Up to SET_BOUND windows it goes to the tasks inside the scan's expression: the scan hashes each
word once, looks up the hash of each window's word hashes, and keeps the few windows that hit;
no row is made per window.  Beyond that the windows' hashes (a long and an int each) are broadcast to
a join, up to JOIN_BOUND of them, and beyond that shuffled.  Hits are verified by their words.

Both sides fold the same way, A-Z to a-z word by word, so equal windows have equal hashes.

Documents that share the same set of windows share one list of items, worked out once.

Defined cases: null and wordless texts have no words and no hits; wordless items match nothing;
items equal in text all count; repeated rows give repeated results; an item id of null counts as
no item but its windows hit; empty tables are fine; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, columns_of, free_name, numbered, sha256_hex, spread_join, temporary, written

WINDOW = 13
SET_BOUND = 1 << 16
JOIN_BOUND = 1 << 20
#: Bytes of window texts that are broadcast for verification.
TEXT_BOUND = 16 << 20
#: Characters that separate words, before and after lower-casing A-Z.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_HITS = "cast(array() as array<struct<at: int, len: int, window: string>>)"


def words_sql(text: str) -> str:
    """SQL: the words of a text, A-Z in lower case.  Only a word of ASCII takes the faster `lower`,
    which is the same there; elsewhere it folds more, and by context."""
    gaps = GAPS.replace("\\", "\\\\")
    return (
        f"transform(array_remove(split(coalesce({text}, ''), '{gaps}'), ''), "
        f"x -> if(length(x) = octet_length(x), lower(x), translate(x, '{UPPER}', '{LOWER}')))"
    )


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, len, window (words joined by a space), hash (of the words' hashes)."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select("item_id", F.expr(words_sql("text")).alias("w")).where("size(w) > 0")
    pieces = items.select(
        "item_id",
        F.explode(
            F.expr(
                f"transform(sequence(0, greatest(size(w) - {WINDOW}, 0)), "
                f"i -> slice(w, i + 1, least({WINDOW}, size(w))))"
            )
        ).alias("p"),
    )
    return pieces.select(
        "item_id",
        F.size("p").alias("len"),
        F.array_join("p", " ").alias("window"),
        F.expr("xxhash64(transform(p, x -> xxhash64(x)))").alias("hash"),
    ).distinct()


def _windows_at(n: int, places: str) -> str:
    """SQL over the words w: hits at the given places of n-word windows."""
    return f"transform({places}, i -> struct(i as at, {n} as len, array_join(slice(w, i + 1, {n}), ' ') as window))"


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "bigint(-9223372036854775808)"


def _candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """uid, doc_id, n_words, hits(at, len, window): windows whose hash is in the set."""
    hashes = written(windows.select("len", "hash").distinct(), "window-hashes")
    count = hashes.count()
    if count > SET_BOUND:
        return _joined_candidates(docs, F.broadcast(hashes) if count <= JOIN_BOUND else hashes)
    known: dict[int, list[int]] = {}
    for r in hashes.collect():  # at most SET_BOUND rows
        known.setdefault(r["len"], []).append(r["hash"])
    scans = []
    for n in sorted(known):
        test = f"xxhash64(slice(h, i + 1, {n})) in ({', '.join(map(_long, sorted(known[n])))})"
        places = f"filter(sequence(0, size(w) - {n}), i -> {test})"
        scans.append(f"if(size(w) >= {n}, {_windows_at(n, places)}, {NO_HITS})")
    found = f"concat({', '.join(scans)})" if scans else NO_HITS
    # transform(array(x), w -> ...)[0] binds w once; an inlined column would be worked out anew per window
    scan = (
        f"transform(array({words_sql('text')}), w -> transform(array(transform(w, x -> xxhash64(x))), "
        f"h -> struct(size(w) as n_words, {found} as hits))[0])[0]"
    )
    return docs.withColumn("scan", F.expr(scan)).select("uid", "doc_id", "scan.n_words", "scan.hits")


def _joined_candidates(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The same for a benchmark too large for the scan's expression: windows are rows."""
    docs = written(docs.select("uid", "doc_id", F.expr(words_sql("text")).alias("w")), "doc-words")
    hits = None
    for n in [r["len"] for r in hashes.select("len").distinct().collect()]:  # at most WINDOW values
        every = docs.where(F.size("w") >= n).select("uid", F.expr("transform(w, x -> xxhash64(x))").alias("h"))
        hashed = f"inline(transform(sequence(0, size(h) - {n}), i -> struct(i as at, {n} as len, xxhash64(slice(h, i + 1, {n})) as hash)))"
        every = every.select("uid", F.expr(hashed))
        hits = every if hits is None else hits.unionByName(every)
    found = hits.join(hashes, ["len", "hash"], "left_semi").groupBy("uid").agg(F.collect_list(F.struct("at", "len")).alias("found"))
    window = "transform(coalesce(found, array()), h -> struct(h.at as at, h.len as len, array_join(slice(w, h.at + 1, h.len), ' ') as window))"
    return docs.join(found, "uid", "left").select("uid", "doc_id", F.size("w").alias("n_words"), F.expr(window).alias("hits"))


def _verified(scanned: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits whose words are a window's (uid, at, len, wid), and the items of each window (wid, item_id)."""
    texts = written(windows.select("window", "len").distinct().withColumn("wid", F.monotonically_increasing_id()), "window-texts")
    items = windows.where("item_id is not null").join(texts, ["window", "len"]).select("wid", F.col("item_id").cast("string").alias("item"))
    spots = scanned.where("size(hits) > 0").select("uid", F.inline("hits"))
    if (texts.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0) <= TEXT_BOUND:
        return spots.join(F.broadcast(texts), ["window", "len"]).select("uid", "at", "len", "wid"), items
    counts = spots.groupBy("window", "len").agg(F.count(F.lit(1)).alias("n"))
    seen = written(counts.join(texts, ["window", "len"]), "windows-seen")
    return spread_join(spots, seen, ["window", "len"], "n", ["uid"], "inner").select("uid", "at", "len", "wid"), items


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (covered word ranges) of
    every row."""
    windows = written(benchmark_windows(benchmark, item_col, "text"), "windows")
    source = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    scanned = written(_candidates(source, windows), "scanned")
    hits, items = _verified(scanned, windows)
    per_doc = hits.groupBy("uid").agg(
        F.array_sort(F.collect_set(F.struct("at", "len"))).alias("spans"), F.array_sort(F.collect_set("wid")).alias("wids")
    )
    per_doc = written(per_doc.withColumn("key", F.sha2(F.array_join("wids", ","), 256)), "hits")
    # one list of items for each set of windows, however many documents have it
    keys = per_doc.groupBy("key").agg(F.first("wids").alias("wids"), F.count(F.lit(1)).alias("n"))
    listed = (
        keys.select("key", F.explode("wids").alias("wid")).join(items, "wid").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    listed = keys.select("key", "n").join(listed, "key", "left").select(
        "key", "n", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), sha256_hex(F.array_join("items", ",")).alias("items_sha256")
    )
    found = spread_join(per_doc.drop("wids"), written(listed, "item-lists"), ["key"], "n", ["uid"], "inner").drop("key")
    covered = "array_distinct(flatten(transform(spans, s -> sequence(s.at, s.at + s.len - 1))))"
    out = scanned.select("uid", "doc_id", "n_words").join(found, "uid", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.expr(f"size({covered})"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", sha256_hex(F.lit(""))).alias("items_sha256"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<at: int, len: int>>)")).alias("spans"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its contaminated rows, and with the covered words (each with the gap after it)
    cut out of the others.  All columns stay; untouched texts are unchanged."""
    rows, uid = numbered(docs)
    bad, spans = free_name(rows.columns, "__bad"), free_name(rows.columns, "__spans")
    with temporary(docs.sparkSession):
        found = contamination(rows, benchmark, id_col=uid, text_col=text_col).where("n_hit > 0")
        found = found.select(F.col("doc_id").alias(uid), F.col("contaminated").alias(bad), F.col("spans").alias(spans))
        found = written(found, "contaminated", keep=True)
    gaps = GAPS.replace("\\", "\\\\")
    text = "`" + text_col.replace("`", "``") + "`"
    # bound once by the transform of a one-element array: pieces, gaps between them, which words go
    # (numbers 2k for all words and 2k + 1 for covered ones, sorted: word k goes if its pair is there)
    covered = f"array_distinct(flatten(transform({spans}, s -> sequence(s.at, s.at + s.len - 1))))"
    gone = (
        f"transform(array(array_sort(concat(transform(sequence(0, size(p) - 1), k -> 2 * k), transform({covered}, k -> 2 * k + 1)))), "
        "s -> transform(filter(transform(s, (v, j) -> struct(v as v, coalesce(get(s, j + 1), -1) = v + 1 as gone)), y -> y.v % 2 = 0), y -> y.gone))[0]"
    )
    bound = (
        f"transform(array(split({text}, '{gaps}', -1)), p -> "
        f"transform(array(struct(p as p, regexp_extract_all({text}, '{gaps}', 0) as g, {gone} as gone)), x -> "
    )
    kept = (
        "array_join(transform(sequence(0, size(x.p) - 1), i -> if(x.p[i] <> '' and get(x.gone, i - int(x.p[0] = '')), '', "
        "concat(x.p[i], if(i < size(x.g), x.g[i], '')))), ''))[0])[0]"
    )
    joined = rows.join(found, uid, "left").where(f"not coalesce(`{bad}`, false)")
    cut = F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.expr(bound + kept))
    return joined.withColumn(text_col, cut).select(*columns_of(docs))

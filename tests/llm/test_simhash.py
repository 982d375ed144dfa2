import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import simhash as S
from brindle.llm.components import components


def fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[find(b)] = find(a)
    return {n: find(n) for n in nodes}


def brute(rows, radius=4):
    prints = [(i, fingerprint(t)) for i, t in rows]
    distinct = sorted({p for _, p in prints})
    of = classes(distinct, [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= radius])
    least = {}
    for i, p in prints:
        if i is not None:
            least[of[p]] = min(least.get(of[p], i), i)
    return sorted(((i, f"{p:016x}", least.get(of[p])) for i, p in prints), key=str)


def test_against_brute_force(both):
    got = sorted(map(tuple, S.near_duplicates(both).collect()), key=str)
    assert got == brute([tuple(r) for r in both.collect()])


@pytest.mark.parametrize("limit", [2, 5, 40])
def test_large_shards_lose_no_link(spark, limit):
    rng = np.random.default_rng(limit)
    fps = [int(x) for x in rng.integers(0, 1 << 62, 3)]
    prints = []
    for i in range(150):
        fp = fps[i % 3]
        for b in rng.integers(0, 62, rng.integers(0, 7)):
            fp ^= 1 << int(b)
        prints.append((i, fp))
    df = spark.createDataFrame(prints, "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in S.fingerprint_components(df, 4, limit).collect()}
    distinct = sorted({p for _, p in prints})
    of = classes(distinct, [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 4])
    least = {}
    for i, p in prints:
        least.setdefault(of[p], i)
    assert got == {p: least[of[p]] for p in distinct}


def test_spark_hash_is_the_same(spark):
    text = "one two three four"
    assert spark.sql(f"select xxhash64('{text}')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(text, 42)


@pytest.mark.parametrize(("spread", "n"), [(3, 300), (8, 400), (64, 200)])
def test_forest_finds_every_link(spread, n):
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 1 << 63, 5).astype(np.uint64)
    fps = centres[rng.integers(0, 5, n)]
    for _ in range(spread):
        fps = fps ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    group = np.sort(rng.integers(0, 3, n))
    parent, edge = S.build_forest(fps, group)
    for i in range(n):
        if parent[i] >= 0:
            assert edge[i] == (int(fps[i]) ^ int(fps[parent[i]])).bit_count() and parent[i] < i and group[i] == group[parent[i]]
    children = [(p, e) for p, e in zip(parent.tolist(), edge.tolist()) if p >= 0]
    assert len(children) == len(set(children))  # one child for each distance
    for radius in (0, 4):
        got = {(int(a), int(b)) for x, y in S.search_forest(fps, group, parent, edge, radius) for a, b in zip(x, y)}
        want = {
            (i, j) for j, i in combinations(range(n), 2) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius
        }
        assert got == want


@settings(max_examples=60)
@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), max_size=4), st.sampled_from([10, 10**7, 10**8, 10**11]))
def test_linked_prints_share_a_shard(fp, flips, count):
    other = fp
    for b in flips:
        other ^= 1 << b
    assert any(fp & m == other & m for m in S.block_masks(4, count))


def test_masks_grow_with_the_data():
    assert [len(S.block_masks(4, n)) for n in (0, 1000, 10**8, 10**12)] == [5, 5, 15, 70]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    df = spark.createDataFrame(edges or [(1, 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    nodes = {x for e in edges for x in e}
    of = classes(nodes, edges)
    for n in nodes:
        assert got.get(n, n) == min(m for m in nodes if of[m] == of[n])


def test_long_chain(spark):
    df = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in components(df).collect()} == {0}


def test_near_copies_go(spark, documents):
    """Copies with one word in sixty replaced are grouped with their originals; others stay."""
    base = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect() if len(r["text"].split()) > 120][:20]
    edited = []
    for i, t in base:
        words = t.split()
        words[30::60] = ["changed"] * len(words[30::60])
        edited.append((1000 + i, " ".join(words)))
    alone = [(5000 + i, " ".join(f"{w}{i}x{n}" for n, w in enumerate("a b c d e f g h".split()))) for i in range(30)]
    df = spark.createDataFrame(base + edited + alone, "doc_id long, text string").repartition(4)
    left = [r["doc_id"] for r in S.drop_near_copies(df).collect()]
    assert {i for i, _ in alone} <= set(left)
    shingle = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    sets = {i: shingle(t) for i, t in base}
    alike = {1000 + i for (i, a), (_, b) in zip(base, edited) if len(shingle(a) & shingle(b)) >= 0.8 * len(shingle(a) | shingle(b))}
    assert len(alike) >= 18 and not set(left) & alike
    for i in set(sets) - set(left):  # dropped originals are near copies of other originals
        assert any(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6 for j in sets if j < i)


def test_near_copies_odd_rows(odd, empty):
    left = S.drop_near_copies(odd)
    assert left.columns == odd.columns
    assert {10, 11, 12} <= {r["doc_id"] for r in left.collect()}
    assert S.drop_near_copies(empty).collect() == []
    assert S.near_duplicates(empty).collect() == []


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def kept_by_brute_force(rows, n=4, d=5):
    """Ids that stay: the least of each component of pairs of Jaccard similarity n/d or more."""
    sets = {i: shingle_set(t) for i, t in rows}
    alike = [(a, b) for a, b in combinations(sorted(sets), 2) if d * len(sets[a] & sets[b]) >= n * len(sets[a] | sets[b])]
    of = classes(sorted(sets), alike)
    least = {}
    for i in sorted(sets):
        least.setdefault(of[i], i)
    return sorted(least.values())


def invented(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_pairs_below_the_similarity_stay(spark):
    """Similarity 0.70 to 0.79 is no near copy, whatever the length; 0.8 itself is one."""
    rng = np.random.default_rng(5)
    rows, shares = [], []
    for i in range(24):
        words = invented(rng, 300 + 20 * i)
        extra = invented(rng, int(len(words) * (1 / (0.70 + 0.0037 * i) - 1)))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + extra))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        shares.append(len(a & b) / len(a | b))
    assert min(shares) >= 0.69 and max(shares) < 0.8
    words = invented(rng, 404)
    rows += [(100, " ".join(words)), (101, " ".join(words + invented(rng, 100)))]  # 400 shingles of 500
    left = sorted(r["doc_id"] for r in S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == [*range(48), 100] == kept_by_brute_force(rows)


@pytest.mark.parametrize("share", [0.1, 0.15, 0.19])
def test_extended_and_truncated_copies_go(spark, share):
    """Block edits: a foreign passage before or behind, or a part cut away."""
    rng = np.random.default_rng(int(100 * share))
    rows = []
    for i in range(25):
        words = invented(rng, int(rng.integers(100, 1500)))
        n = int(len(words) * share)
        more = invented(rng, n)
        versions = [words, words + more, more + words, words[n:], words[: len(words) - n]]
        rows += [(10 * i + k, " ".join(x)) for k, x in enumerate(versions)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = sorted(r["doc_id"] for r in S.drop_near_copies(df).collect())
    assert left == kept_by_brute_force(rows) and len(left) < 40


@pytest.mark.parametrize("cell_rows", [S.CELL_ROWS, 9])
def test_copies_among_common_passages(spark, cell_rows):
    """A passage that all texts share, and a large group of copies, hide no pair."""
    rng = np.random.default_rng(9)
    passage, base = invented(rng, 60), invented(rng, 200)
    rows = []
    for i in range(120):
        words = list(base) if i % 3 == 0 else invented(rng, 150)
        words[i % 100 : i % 100 + 4] = invented(rng, int(rng.integers(1, 12)))
        rows.append((i, " ".join(passage + words)))
    rows += [(200 + i, " ".join(t.split()[: 190 + i])) for i, t in rows[::7]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = S.drop_near_copies(df, cell_rows=cell_rows)
    assert sorted(r["doc_id"] for r in left.collect()) == kept_by_brute_force(rows)

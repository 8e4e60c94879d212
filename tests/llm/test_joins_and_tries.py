"""Centroids, the n-gram join and the prefix trie against brute force and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrywork.llm import clustering, part_enum, prefix_trie

# --- centroids ---


def plain_clusters(rows, dims, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[near(v)[1]].append(v)
        c = [[sum(x) // len(held[j]) for x in zip(*held[j])] if held[j] else c[j] for j in range(len(c))]
    found = [(i, *near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, j in found:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def vectors(n, dims, seed=1):
    rng = random.Random(seed)
    at = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.4) for x in at[i % 5]]) for i in range(n)]


@pytest.mark.parametrize("few", [clustering.FEW, 0])
def test_clusters_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(clustering, "FEW", few)
    odd = [(900, None), (901, [1.0]), (902, [None] * 6), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (None, [0.5] * 6), (7, [0.25] * 6), (7, [0.25] * 6)]
    rows = vectors(150, 6) + [(1000 + i, [0.125] * 6) for i in range(80)] + odd
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, cluster int")
    got = sorted((tuple(r) for r in clustering.cluster_vectors(df, dims=6).collect()), key=repr)
    assert got == plain_clusters(rows, 6)


def test_few_or_no_vectors(spark):
    shape = "vec_id long, embedding array<double>"
    assert clustering.cluster_vectors(spark.createDataFrame([(1, [1.0])], shape)).count() == 0
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1e300])]
    got = clustering.cluster_vectors(spark.createDataFrame(rows, shape), dims=2).collect()
    assert sorted(r.vec_id for r in got) == [1, 2] and {r.distance for r in got} == {0}


def test_intervals_hold_the_distance():
    rng = np.random.default_rng(2)
    v, c = rng.integers(-900, 900, (400, 5)), rng.integers(-900, 900, (8, 5))
    grid = clustering.grid_of(v.min(0), v.max(0), v[:50])
    found, at = clustering.lookup(grid, c), np.arange(5)
    cells, d = grid.cells(v), clustering.distances(v, c)
    low, high = found.low[at, cells].sum(1), found.high[at, cells].sum(1)
    assert (low <= d).all() and (d <= high).all()
    near = found.nearest(cells)
    assert (near >= 0).any() and (near[near >= 0] == d.argmin(1)[near >= 0]).all()


# --- the n-gram join ---


def plain_classes(rows, percent=85, size=4):
    def grams(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [(i, grams(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and (100 * len(x & y) >= percent * len(x | y) or i is not None and i == j):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, x) in enumerate(sets):
        least[find(a)].append(i)
    smallest = lambda a: min((i for i in least[find(a)] if i is not None), default=None)
    return sorted(((i, len(x), smallest(a) if x else i) for a, (i, x) in enumerate(sets)), key=repr)


def test_join_finds_every_link(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    texts, base = [], []
    for n in (1, 3, 4, 5, 9, 12, 16, 20, 26, 33, 60, 150, 400):
        base.append([word() for _ in range(n)])
        for _ in range(12):
            t = list(base[-1])
            for _ in range(rng.randrange(0, 2 + n // 50)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t + [word() for _ in range(rng.randrange(0, 1 + n // 8))]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[-1]) for i in range(40)] + [(None, texts[20]), (None, "nobody has this one"), (3, texts[30]), (600, None), (601, ""), (602, " \t")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, sig string")
    assert sorted((tuple(r) for r in part_enum.jaccard_classes(df).collect()), key=repr) == plain_classes(rows)


def test_open_signatures_lose_no_link(spark, monkeypatch):
    """With one part for all, everything of one size shares signatures; pivots alone would not find all links."""
    monkeypatch.setattr(part_enum, "signatures", lambda s, percent: np.array([1, 2], np.int64)[: 2 if len(s) else 0])
    rng = random.Random(6)
    rows = []
    for g in range(6):
        t = [f"g{g}w{i}" for i in range(60)]
        rows += [(g * 10 + i, " ".join([*t, *[f"x{rng.random()}" for _ in range(i)]])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = [set(part_enum.signatures(np.arange(3), 85).tolist())]
    assert signed == [{1, 2}]
    assert sorted((tuple(r) for r in part_enum.jaccard_classes(df).collect()), key=repr) == plain_classes(rows)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for n in (1, 2, 4, 7, 10, 14, 19, 27, 50, 130, 700, 2500):
        for _ in range(60 if n < 1000 else 5):
            most = math.floor(n * (100 - percent) / percent)
            extra = int(rng.integers(0, most + 1))
            drop = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, extra, dtype=np.uint64)])
            if len(b) and 100 * (n - drop) >= percent * (n + extra):
                assert np.intersect1d(part_enum.signatures(a, percent), part_enum.signatures(b, percent)).size, (n, drop, extra)


def test_sets_that_fall_together_are_dealt_again():
    """Features that the first dealing puts in one half leave the others empty: all dealings are tried, and equal sets always meet."""
    c = next(c for c in part_enum.size_classes(85, 100) if c.parts > 1)
    rng, found = np.random.default_rng(1), []
    while len(found) < c.high:
        s = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        x = s * part_enum._DEAL[0]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        found += s[(x & np.uint64(1)) == 0].tolist()
    s = np.array(found[: c.high], np.uint64)
    dealt = list(part_enum._dealt(s, 0, c))
    assert len(dealt) == 2 and all(len(d) for d in dealt)


def test_join_of_nothing(spark, none):
    assert part_enum.jaccard_classes(none).count() == 0


def test_join_on_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in part_enum.jaccard_classes(odd).collect()), key=repr) == plain_classes(rows)


# --- the prefix trie ---


def plain_trie(rows):
    def order(r):
        mark = hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
        return (r[1] is not None, r[1] or 0, mark)

    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(x, key=order)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += node not in children
    ends = lambda node: ",".join(map(str, sorted(c for c in members[node] if len(built[c]) == len(node))))
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n, m in members.items()), key=repr)


def odd_turns(rng):
    rows = []
    for c in list(range(-12, 30)) + [100, 105, 106]:
        for t in range(rng.randrange(0, 14)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "héllo \U0001f600", "", None])))
    rows += [(200 + i, t, "user", f"same {t}") for i in range(30) for t in range(10)]
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "other"), (7, None, "user", "first"), (7, 1, "user", "tie"), (None, 1, "user", "nobody"), (8, 3, "x", None), (8, 3, "x", None)]
    return rows


TURNS = "conv_id long, turn long, role string, text string, depth string, key int"


@pytest.mark.parametrize("most", [prefix_trie.MOST, 256])
def test_trie_is_exact(spark, monkeypatch, most):
    """With a sketch of a few counters most estimates are too high, which only sends more prefixes to the exact grouping."""
    monkeypatch.setattr(prefix_trie, "MOST", most)
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rows = odd_turns(random.Random(9))
    got = prefix_trie.conversation_trie(spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows)


def test_a_long_conversation_is_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(c, t, "user", f"{t % 7} {c if t > 150 + c else ''}") for c in (1, 2, 3, 5) for t in range(200)]
    got = prefix_trie.conversation_trie(spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows)


def test_places_of_a_hot_conversation_are_spread(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, 7).otherwise(F.col("id")).alias("conv_id"), (20_000 - F.col("id")).alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    placed = prefix_trie.placed_turns(rows)
    assert placed.filter("conv = 7").agg(F.min("place"), F.max("place"), F.countDistinct("place")).first()[:] == (1, 15_000, 15_000)
    assert placed.filter("conv <> 7").agg(F.max("place")).first()[0] == 1


def test_screen_never_hides_a_shared_prefix(spark):
    keys = [(i % 300, 5 * (i % 300)) for i in range(400)]
    bits = prefix_trie.sketch(spark.createDataFrame(keys, "k1 long, k2 long"), prefix_trie.width_of(400))
    a = np.arange(300)
    several = prefix_trie._several(bits, a, 5 * a)
    assert several[:100].all() and several[100:].mean() < 0.05


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n in (1, 20, 300, 4000):
        a, b = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b[: n // 2] = a[: n // 2]
        apart = sum(int(x).bit_count() for x in (part_enum.parities(a) ^ part_enum.parities(b)).view(np.uint64))
        assert apart <= 2 * (n - n // 2) and (n > 300 or apart > (n - n // 2))

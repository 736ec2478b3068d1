import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, exact, near, vectors


def test_exact(spark, hard):
    rows = exact.exact_duplicates(hard).collect()
    texts = [("".join(c.lower() if c.isascii() else c for c in (r.text or "")), r.doc_id) for r in hard.collect()]
    groups = {}
    for t, d in texts:
        groups.setdefault(t, []).append(d)
    want = sorted((str(d), str(max((x for x in groups[t] if x is not None), default=None)), len(groups[t])) for t, d in texts)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups) and exact.exact_duplicates(hard.limit(0)).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_exact_crowds(spark, monkeypatch, few):
    """One text in every batch, and keys too many to broadcast."""
    monkeypatch.setattr(exact, "CROWD", 3)
    if few:
        monkeypatch.setattr(exact, "BROADCAST_ROWS", 0)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").when(F.col("id") % 7 == 0, "warm").otherwise(F.col("id").cast("string")).alias("text")).repartition(40)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(df).collect()}
    hot, warm = [i for i in range(400) if i % 3 == 0], [i for i in range(400) if i % 3 and i % 7 == 0]
    want = {i: (max(g), len(g), i == max(g)) for g in (hot, warm) for i in g}
    assert got == {i: want.get(i, (i, 1, True)) for i in range(400)}


def test_exact_directory(spark):
    entries = spark.range(5000).select(F.xxhash64("id").alias("key")).unionByName(spark.range(100_000).select(F.lit(42).cast("long").alias("key")))
    keys = entries.distinct()
    depth, slots = exact.directory(keys, 100)
    assert len(slots) == 1 << depth and len(slots) <= 64 * 8
    counted = {}
    for r in keys.collect():
        p = (r.key & (1 << 64) - 1) >> (64 - depth) if depth else 0
        counted.setdefault(slots[p], []).append(r.key)
    assert all(len(v) <= 100 for v in counted.values())
    assert exact.directory(keys.limit(0), 100) == (0, [(0, 0)])


def brute_groups(texts):
    bags = {i: near.shingles(near.words_of(t or "")) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in bags if len(bags[i][0]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if near.similarity(bags[a], bags[b]) >= near.THRESHOLD:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in texts}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for k in range(60):
        h = np.unique(rng.integers(0, 1 << 63, rng.integers(3, 200)).astype(np.uint64))
        n = rng.integers(1, 12, len(h)) if k % 2 else np.ones(len(h), int)
        m = np.where(rng.random(len(h)) < 0.3, rng.integers(1, 12, len(h)), n)
        keep = rng.random(len(h)) < 0.9
        keep[0] = True
        s = near.signatures([(h, n), (h[keep], m[keep])])
        errors.append((s[0] == s[1]).mean() - near.similarity((h, n), (h[keep], m[keep])))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.04


def test_near_against_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    texts, n = {}, 0
    for _ in range(25):
        base = list(rng.choice(words, rng.integers(6, 150)))
        for _ in range(rng.integers(1, 12)):
            own = list(base)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(len(own))] = rng.choice(words)
            texts[n] = " ".join(own)
            n += 1
    texts |= {n: "", n + 1: None, n + 2: "one two", n + 3: "One, TWO!", n + 4: "!!!"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in near.groups(df).collect()}
    want = brute_groups(texts)
    assert {i: r.group_id for i, r in got.items()} == want and all(r.kept == (want[i] == i) for i, r in got.items())


def test_near_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)
    base = [f"w{i}" for i in range(80)]
    texts = {i: " ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in near.groups(df).collect()} == brute_groups(texts)


def cell_of(spark, sketch, bands):
    n = len(sketch)
    own = spark.createDataFrame([(i + 1, bands[i].tolist(), bytearray(sketch[i]), 9) for i in range(n)], "id long, bands array<long>, sketch binary, size long")
    places = spark.createDataFrame([(500, 3, i + 1, 1, 1) for i in range(n)], "bucket long, band int, id long, leader long, blocks int")
    return {r.id for r in near.active(places, own, spark.createDataFrame([], "a long, b long")).collect()}


def test_near_chance_agreement_of_sketches(spark):
    # 1 and 2 share the hash of band 3 only; on band 0 their sketches agree by chance
    sketch = np.zeros((2, near.REGISTERS), np.uint8)
    sketch[1, near.ROWS :: near.ROWS] = 1
    sketch[1, 3 * near.ROWS] = 0
    bands = np.arange(2 * near.BANDS).reshape(2, near.BANDS)
    bands[:, 3] = 500
    assert cell_of(spark, sketch, bands) == {1, 2}
    bands[:, 1] = 400  # they meet in an earlier bucket
    assert cell_of(spark, sketch, bands) == set()


def test_near_low_estimates_are_verified(spark):
    # 200 of 280 registers are equal, an estimate of 0.714; 180 are too few
    for equal, found in ((200, {1, 2}), (180, set())):
        sketch = np.zeros((2, near.REGISTERS), np.uint8)
        sketch[1, equal:] = 1
        bands = np.arange(2 * near.BANDS).reshape(2, near.BANDS)
        bands[:, 3] = 500
        assert cell_of(spark, sketch, bands) == found


def test_overlaps_of_bags(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(1, 60))) for _ in range(25)]
    bags, sets = [near.bag_of(t) for t in texts], [near.shingles(near.words_of(t)) for t in texts]
    for dense in (near.DENSE, 1):
        monkeypatch.setattr(near, "DENSE", dense)
        both = near.overlaps(bags)
        for i in range(25):
            for j in range(i):
                union = len(bags[i]) + len(bags[j]) - both[i, j]
                assert abs(both[i, j] / union - near.similarity(sets[i], sets[j])) < 1e-12


def test_near_alike_but_not_linked(spark):
    """Many texts, each some 0.75 like every other: no links, and rows that grow with the texts, not with their pairs."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(120):
        own = list(base)
        for k in rng.choice(400, 5, replace=False):
            own[k] = f"x{i}-{k}"
        texts[i] = " ".join(own)
    texts[120] = texts[7] + " one more"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in near.groups(df).collect()} == brute_groups(texts)


def test_recall_at_the_threshold():
    """Pairs of multisets at 0.80 to 0.82: how many share a band and have a similar sketch."""
    rng = np.random.default_rng(1)
    missed, n = 0, 1500
    for _ in range(n // 50):
        bags = []
        for _ in range(50):
            size = int(rng.integers(60, 200))
            h = np.unique(rng.integers(1, 1 << 62, 2 * size).astype(np.uint64))[: 2 * size]
            shared = int(round(size * 2 * rng.uniform(0.8, 0.82) / (1 + 0.81)))
            a, b = h[:size], np.concatenate([h[:shared], h[size : 2 * size - shared]])
            bags += [(np.sort(x), np.ones(len(x), int)) for x in (a, b)]
        points = near.signatures(bags).view(np.uint64)
        equal = points[::2] == points[1::2]
        meet = equal.reshape(-1, near.BANDS, near.ROWS).all(axis=2).any(axis=1)
        missed += int((~(meet & (equal.mean(axis=1) >= near.LIKELY))).sum())
    assert missed <= 3


def test_near_hard_rows(spark, hard):
    rows = near.groups(hard).collect()
    assert len(rows) == hard.count() and near.groups(hard.limit(0)).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.group_id, r.kept))
    assert by[2] == {(1, False)} and by[1] == {(1, True)} and by[None] == {(None, True)} and by[3] == {(3, True)}


def test_components(spark):
    import random

    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(7, k) for k in range(200, 260)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in pairs if a != b for i in (a, b)}


def brute_links(ids, x, cosine):
    s = x @ x.T >= cosine
    np.fill_diagonal(s, False)
    label = {i: i for i in ids}
    while True:
        new = {i: min([label[i], *(label[ids[j]] for j in np.flatnonzero(s[k]))]) for k, i in enumerate(ids)}
        if new == label:
            return dict(zip(ids, s.sum(axis=1).tolist(), strict=True)), label
        label = new


@pytest.mark.parametrize("dims, spread", [(3, 0.2), (16, 0.08), (64, 0.05)])
def test_vectors_against_brute_force(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(vectors, "LEAST_BLOCK", 64)
    monkeypatch.setattr(vectors, "AT_ONCE", 1000)
    monkeypatch.setattr(vectors, "HEADS", 3)
    monkeypatch.setattr(vectors, "MOST_EDGES", 100)
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(12, dims))
    x = np.concatenate([c + spread * rng.normal(size=(rng.integers(1, 40), dims)) for c in centres] + [rng.normal(size=(60, dims))]).astype(np.float32)
    x = np.concatenate([x, x[:30], x[:30] * 3])
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, weight string")
    n, label = brute_links(ids, vectors.unit(x), 0.9)
    got = {r.vec_id: r for r in vectors.linked(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == label
    # x and 3x differ in the last place at most: links of pairs at the very threshold aside
    assert {i: r.n_links for i, r in got.items()} == n


def test_vectors_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 5.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, None]), (None, [1.0, 0.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.linked(df).collect()
    assert len(got) == len(rows) and {(r.vec_id, r.n_links, r.component_id) for r in got} == {(1, 2, 1), (2, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (None, 0, None), (8, 0, 8), (9, 0, 9), (10, 2, 1)}
    assert vectors.linked(df.limit(0)).count() == 0


def test_vectors_that_share_an_id(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [0.01, 1.0])]
    got = vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)]


@pytest.mark.parametrize("cosine", [0.5, 0.99, 0.9999])
def test_vectors_at_other_thresholds(spark, cosine):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=8) + s * rng.normal(size=(30, 8)) for s in (0.01, 0.05, 0.3, 1.0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    n, label = brute_links(list(range(len(x))), vectors.unit(x), cosine)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.linked(df, cosine).collect()}
    assert got == {i: (n[i], label[i]) for i in n}


def test_local_components():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60):
        for m in (0, 3, n):
            u, v = rng.integers(0, n, m), rng.integers(0, n, m)
            want = np.arange(n)
            for _ in range(n):
                for a, b in zip(u, v, strict=True):
                    want[[a, b]] = want[[a, b]].min()
            assert (vectors.components(n, u, v) == want).all()


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0]), (6, [1.0]), (7, [2.0])]
    got = vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6)}

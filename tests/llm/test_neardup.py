import numpy as np
import pytest

from tessellar.llm.components import components
from tessellar.llm.neardup import PLACES, band_keys, missed, near_duplicates, superminhash
from tessellar.llm.words import mix


def one_by_one(elements, m=PLACES):
    """The algorithm as published, an element at a time."""
    out = np.full(m, 2**64 - 1, np.uint64)
    for e in elements.tolist():
        p = list(range(m))
        for j in range(m):
            x = int(mix(np.array([(e + 0x9E3779B97F4A7C15 * (j + 1)) % 2**64], np.uint64))[0])
            k = j + ((x & 0xFFFFFFFF) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(int(out[p[j]]), x >> 32 | j << 32)
    return out


def test_signatures():
    r = np.random.default_rng(0)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 0, 30, 300)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for s, got in zip(sets, superminhash(np.concatenate(sets), first), strict=True):
        assert (one_by_one(s) == got).all()
    same = superminhash(np.concatenate([sets[4], sets[4][::-1]]), np.array([0, 300, 600]))
    assert (band_keys(same)[0] == band_keys(same)[1]).all() and len(set(band_keys(same)[0].tolist())) == 32


@pytest.mark.parametrize("similarity", [0.4, 0.5])
def test_share_of_pairs_that_banding_misses(similarity):
    r, n, pairs = np.random.default_rng(7), 70, 1500
    both = round(2 * n * similarity / (1 + similarity))
    elements = r.integers(0, 2**63, (pairs, 2 * n - both)).astype(np.uint64)
    a, b = elements[:, :n], elements[:, n - both :]
    first = np.arange(pairs + 1) * n
    x, y = band_keys(superminhash(a.ravel(), first)), band_keys(superminhash(b.ravel(), first))
    share = 1 - (x == y).any(axis=1).mean()
    want = missed(both / (2 * n - both))
    assert abs(share - want) < 4 * np.sqrt(want * (1 - want) / pairs) and abs(missed(0.75) - 5.17e-6) < 1e-8


def brute(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode()
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in w).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                least[q] = p
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[words[k] for k in r.integers(0, 300, n)] for n in (40, 60, 25, 9, 5)]
    rows = []
    for i in range(90):
        w = list(base[i % 5])
        for _ in range(int(r.integers(0, 5))):  # chains of near copies around the threshold
            w[int(r.integers(len(w)))] = words[int(r.integers(300))]
        rows.append((i * 3 + 1, " ".join(w)))
    rows += [(0, None), (2, ""), (3, "  \n "), (5, "One two"), (6, "one  TWO"), (8, "one two three"), (9, "Été Déjà"), (11, "été déjà"), (500, rows[0][1] + " x")]
    df = spark.createDataFrame([(*row, "s", 1) for row in rows], "doc_id long, text string, component_id string, n int")
    got = sorted(tuple(x) for x in near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other words here"), (None, "a b c"), (4, "A b C"), (7, "other words here")], "doc_id long, text string")
    got = sorted(((x.doc_id or -1), x.component_id, x.kept) for x in near_duplicates(df).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (1, 1, True), (4, 1, False), (7, 1, False)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    r = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in r.integers(0, 60, (40, 2))] + [(100 + k, 101 + k) for k in range(30)] + [(7, 7), (None, 3)]
    least = list(range(200))
    for _ in range(200):
        for a, b in links:
            if a is not None:
                least[a] = least[b] = min(least[a], least[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: least[n] for a, b in links if a is not None and a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_large_group_around_the_threshold(spark):
    """Variants of one text of which many are too far from its least id: links go through others; some reach none."""
    r = np.random.default_rng(5)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for i in range(700):
        words = list(base)
        for at in r.choice(90, int(r.integers(1, 5)), replace=False):
            words[at] = f"x{i}-{at}"
        rows.append((i * 3, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(86)} for i, t in rows}
    ids = sorted(sets)
    above = {i: i for i in ids}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                above[y] = x
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: root(i) for i in ids}
    assert len(set(got.values())) > 1

import hashlib
import math
import random

import numpy as np

from tessellar.llm import centroids
from tessellar.llm.queries import op11_centroid_clustering


def plain(rows, k=16, rounds=3, dim=64):
    """The contract in Python's integers."""
    kept = [(i, [math.floor(64 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    name = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    means = [x for _, x in sorted(kept, key=name)[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(means))

    for _ in range(rounds):
        held = {}
        for _, x in kept:
            held.setdefault(near(x)[1], []).append(x)
        for j, some in held.items():
            means[j] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    found = [(i, *near(x)) for i, x in kept]
    total, by = sum(d for _, d, _ in found), {}
    for _, d, j in found:
        by[j] = by.get(j, 0) + d
    return sorted(((i, j, d, by[j], total, hashlib.sha256(",".join(map(str, means[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def rows_of(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(op11_centroid_clustering(spark, sf)) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(20)]
    rows = [(k, base[k % 20]) for k in range(60)] + [(None, base[0]), (7, base[1]), (7, base[2]), (100, None), (101, []), (102, [1.0] * 5), (103, [1.0, None, 1.0, 1.0]), (104, [1.0, math.nan, 1.0, 1.0]), (105, [math.inf, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(5)
    for block in (4, 1024):
        assert rows_of(centroids.cluster(df, k=3, dim=4, block=block)) == plain(rows, k=3, dim=4)
    assert rows_of(centroids.cluster(df.limit(0))) == []
    few = df.where("vec_id = 5")
    assert rows_of(centroids.cluster(few, dim=4)) == plain([r for r in rows if r[0] == 5], dim=4)


def test_large_integers(spark):
    rows = [(k, [float(k % 3) * 1e6, 1e5 * k]) for k in range(30)] + [(50, [3e7, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(centroids.cluster(df, k=4, dim=2, block=8)) == plain(rows, k=4, dim=2)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1e200, 5.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in centroids.cluster(huge, k=2, dim=2).collect()}
    assert len(got) == 3 and all(r["inertia"] is None or r["inertia"] >= 0 for r in got.values())


def test_trees_cover_part_and_prune():
    rng = np.random.default_rng(2)
    spots = rng.integers(-400, 400, (12, 8))
    points = (spots[rng.integers(0, 12, 900)] + rng.integers(-4, 5, (900, 8))).astype(np.int64)
    points[100:400] = points[0]
    tree = centroids.Tree(points, 6)
    assert sorted(tree.order) == list(range(900))
    gap = lambda a, b: np.sqrt(((points[a] - points[b]) ** 2).sum(-1))
    for n in range(len(tree.centre)):
        rows = tree.order[tree.start[n] : tree.stop[n]]
        assert (gap(rows, tree.centre[n]) <= tree.radius[n]).all()
        children = tree.children[tree.begins[n] : tree.begins[n] + tree.counts[n]]
        if len(children):
            assert tree.start[children[0]] == tree.start[n] and tree.stop[children[-1]] == tree.stop[n] and (tree.start[children[1:]] == tree.stop[children[:-1]]).all()
            centres, widest = tree.centre[children], tree.radius[children].max()
            apart = [gap(a, b) for i, a in enumerate(centres) for b in centres[:i]]
            assert not apart or min(apart) > widest * 0.999
    middles = np.concatenate([spots, spots[:2]]).astype(np.int64)
    want = ((points[:, None] - middles[None]) ** 2).sum(2)
    label, distance, taken, computed = centroids.nearest(points, centroids.Tree.load(tree.dump()), middles, False)
    assert (label == want.argmin(1)).all() and (distance == want.min(1)).all() and not taken
    assert computed < 0.6 * want.size
    label, _, taken, fewer = centroids.nearest(points, tree, middles, True)
    for n, c in taken:
        rows = tree.order[tree.start[n] : tree.stop[n]]
        assert (label[rows] == -1).all()
        label[rows] = c
    assert (label == want.argmin(1)).all() and len(taken) and fewer < 0.2 * want.size

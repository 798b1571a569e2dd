"""Lloyd's rounds over two trees: a cover tree over the vectors, and one over the centroids made anew each round.

Vectors are dealt as they are read: each task packs its vectors into blocks of 1,024 and builds a cover tree over each.
A node has a centre, a radius, the sum and the number of its vectors; children of a node are more than their scale apart and
every vector is within its node's scale. The blocks are written once; a round reads them, descends pairs of a vector node and a
centroid node from the roots, and drops a pair whose least distance is above the greatest of another pair of the same vector
node. A vector node with one centroid left adds its sum as a whole; pairs of leaves are compared exactly in integers.
A task hands on one sum for each centroid and component, and k x dim sums reach the driver.

Vectors that are null, have a null or non-finite component, or not exactly ``dim`` components are left out. Integers are
floor(64 * x), x as double. Copies are points of one leaf. Fewer vectors than centroids: one centroid a vector. No vectors: no rows.
A null id hashes as the empty text; rows that repeat an id are vectors of their own, in the order of their components where
their hashes tie. A block with a component of 2^22 or more in size is one leaf of Python's integers; a distance or
inertia that no long holds is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import cut, small_batches, written

DIM = 64
K = 16
ROUNDS = 3
BLOCK = 1024
LEAF = 24
EXACT = 1 << 22
LIMB = 1 << 60
#: Distances in doubles are off by less than this share; bounds give way by it.
SLACK = 1e-9


def usable(vector: Column, dim: int | None = None) -> Column:
    """Whether no entry is null or non-finite, and the length is ``dim`` if that is given."""
    fine = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return F.coalesce(fine & (F.size(vector) == dim) if dim is not None else fine, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An array column of equal lengths as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def grid(x: np.ndarray) -> np.ndarray:
    """floor(64 * x) as int64, or as Python's integers where one is too large for exact squares."""
    y = np.floor(64.0 * x)
    return y.astype(np.int64) if not y.size or np.abs(y).max() < EXACT else np.array([[int(v) if np.isfinite(v) else int(w) * 64 for v, w in zip(r, q, strict=True)] for r, q in zip(y, x, strict=True)], object)


class Tree:
    """A cover tree over the rows of a matrix; at most ``leaf`` rows, or a radius of 0, end a branch. Rows of Python's integers are one leaf.

    Nodes are in pre-order: centre (a row), radius, span of ``order``, and the children as one array with where each node's begin.
    """

    FIELDS = ("order", "centre", "radius", "start", "stop", "counts", "begins", "children")

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        n = len(points)
        self.order = np.arange(n)
        if points.dtype == object:
            self.centre, self.radius = np.zeros(1, np.int64), np.full(1, np.inf)
            self.start, self.stop, self.counts, self.begins, self.children = np.zeros(1, np.int64), np.full(1, n), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
            return
        x = points.astype(np.float64)  # products of such integers are exact in doubles
        norm = (x * x).sum(1)
        reach = lambda rows: np.sqrt(np.maximum(0, norm[rows] + norm[rows[0]] - 2 * (x[rows] @ x[rows[0]])))
        centre, radius, start, stop, inside = [], [], [], [], []
        todo = [(0, n, -1, np.inf)]
        while todo:
            first, last, parent, scale = todo.pop()
            rows = self.order[first:last]
            me, far = len(centre), reach(rows)
            if parent >= 0:
                inside[parent].append(me)
            centre.append(rows[0])
            radius.append(float(far.max()))
            start.append(first)
            stop.append(last)
            inside.append([])
            if last - first <= leaf or not radius[-1]:
                continue
            scale, at, spans = min(scale, radius[-1]) / 2, first, []
            while len(rows):  # the first vector that none covers is the next centre, and covers what is within its scale
                near = (far if at == first else reach(rows)) <= scale
                covered, rows = rows[near], rows[~near]
                spans.append((at, at + len(covered), covered))
                at += len(covered)
            for a, b, covered in spans:
                self.order[a:b] = covered
            todo += [(a, b, me, scale) for a, b, _ in reversed(spans)]
        self.centre, self.radius = np.array(centre, np.int64), np.array(radius) * (1 + SLACK)
        self.start, self.stop = np.array(start, np.int64), np.array(stop, np.int64)
        self.counts = np.array([len(c) for c in inside], np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        self.children = np.array([c for some in inside for c in some], np.int64)

    def dump(self) -> list[bytes]:
        return [getattr(self, f).astype(np.float64 if f == "radius" else np.int64).tobytes() for f in self.FIELDS]

    @classmethod
    def load(cls, raw: list[bytes]) -> Tree:
        tree = cls.__new__(cls)
        for f, r in zip(cls.FIELDS, raw, strict=True):
            setattr(tree, f, np.frombuffer(r, np.float64 if f == "radius" else np.int64))
        return tree


def _expanded(nodes: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """For each child the place of its node, and the child; a leaf stands for itself."""
    counts = np.maximum(tree.counts[nodes], 1)
    which = np.repeat(np.arange(len(nodes)), counts)
    place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    child = nodes[which]
    inner = tree.counts[child] > 0
    child[inner] = tree.children[tree.begins[child[inner]] + place[inner]]
    return which, child


def _rows(nodes: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """For each row of the nodes the place of its node, and the row."""
    counts = tree.stop[nodes] - tree.start[nodes]
    which = np.repeat(np.arange(len(nodes)), counts)
    return which, tree.order[np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + tree.start[nodes[which]]]


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], int]:
    """Centroid and exact squared distance of each row (-1 where its node was taken whole), those nodes with their centroid, and the number of distances computed.

    With ``whole`` a node with one centroid left is taken by its sum; else all are descended to their rows.
    """
    other = Tree(centroids, 1)
    label, distance = np.full(len(points), -1, np.int64), np.zeros(len(points), object if object in (points.dtype, centroids.dtype) else np.int64)
    a, b = points[tree.centre].astype(np.float64), centroids[other.centre].astype(np.float64)
    loose = SLACK * (np.abs(a).max() + np.abs(b).max())
    most, computed = np.full(len(tree.centre), np.inf), 0
    taken: list[tuple[int, int]] = []
    ends_p: list[np.ndarray] = []
    ends_c: list[np.ndarray] = []
    p, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    with np.errstate(all="ignore"):  # integers that doubles can't square have infinite bounds, which drop nothing
        while len(p):
            computed += len(p)
            apart, spread = np.sqrt(((a[p] - b[c]) ** 2).sum(1)), tree.radius[p] + other.radius[c]
            upper = apart + spread
            np.minimum.at(most, p, np.where(np.isnan(upper), np.inf, upper * (1 + SLACK) + loose))
            keep = ~((apart - spread) * (1 - SLACK) - loose > most[p])
            p, c = p[keep], c[keep]
            if whole:
                left = np.bincount(p, minlength=len(tree.centre))
                alone = (left[p] == 1) & (tree.counts[p] > 0) & (other.radius[c] == 0)  # copies of a centroid share a leaf: the least number counts
                taken += [(int(n), int(other.order[other.start[k] : other.stop[k]].min())) for n, k in zip(p[alone], c[alone], strict=True)]
                p, c = p[~alone], c[~alone]
            ends = (tree.counts[p] == 0) & (other.counts[c] == 0)
            ends_p.append(p[ends])
            ends_c.append(c[ends])
            which, deeper = _expanded(p[~ends], tree)
            below, c = _expanded(c[~ends][which], other)
            p = deeper[below]
    p, c = np.concatenate(ends_p), np.concatenate(ends_c)
    for some in np.array_split(np.argsort(p, kind="stable"), max(1, len(p) // 4096)):  # pairs of leaves, compared exactly
        which, row = _rows(p[some], tree)
        again, number = _rows(c[some][which], other)
        row = row[again]
        d = ((points[row] - centroids[number]) ** 2).sum(1)
        computed += len(d)
        order = np.lexsort((number, d, row)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (row[i], d[i], number[i])), np.int64)
        first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
        # pairs of a node may fall into two parts
        better = first[(label[row[first]] < 0) | (d[first] < distance[row[first]]) | ((d[first] == distance[row[first]]) & (number[first] < label[row[first]]))]
        label[row[better]], distance[row[better]] = number[better], d[better]
    return label, distance, taken, computed


BLOCKS = "vec_id array<long>, vectors binary, wide boolean, tree array<binary>"


def _blocks(dim: int, block: int):
    """Packs a task's vectors into blocks, each with its cover tree."""

    def out(ids: list, rows: list) -> pa.RecordBatch:
        y = grid(np.concatenate(rows))
        raw = y.astype(np.int32).tobytes() if y.dtype != object else "\n".join(" ".join(map(str, r)) for r in y).encode()
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([raw], pa.binary()), pa.array([y.dtype == object]), pa.array([Tree(y, LEAF).dump()], pa.list_(pa.binary()))], names=["vec_id", "vectors", "wide", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        rows: list[np.ndarray] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, block - len(ids))
                ids += some.column("vec_id").to_pylist()
                rows.append(matrix(some.column("vector"), dim))
                at += some.num_rows
                if len(ids) == block:
                    yield out(ids, rows)
                    ids, rows = [], []
        if ids:
            yield out(ids, rows)

    return run


def _opened(batch: pa.RecordBatch, k: int, dim: int) -> tuple[np.ndarray, Tree]:
    raw = batch.column("vectors")[k].as_py()
    if batch.column("wide")[k].as_py():
        points = np.array([[int(v) for v in line.split()] for line in raw.decode().split("\n")], object)
    else:
        points = np.frombuffer(raw, np.int32).astype(np.int64).reshape(-1, dim)
    return points, Tree.load(batch.column("tree")[k].as_py())


def _array(centroids: list[list[int]]) -> np.ndarray:
    return np.array(centroids, np.int64 if all(abs(v) < EXACT for c in centroids for v in c) else object)


def _sums(centroids: list[list[int]], dim: int):
    """A task's sums by centroid and component, in limbs of 2^60 as they may have any size, and at component -1 the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _array(centroids)
        total, number = np.zeros((len(held), dim), object), np.zeros(len(held), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                points, tree = _opened(batch, at, dim)
                label, _, taken, _ = nearest(points, tree, held, True)
                for n, c in taken:
                    rows = tree.order[tree.start[n] : tree.stop[n]]
                    total[c] += points[rows].sum(0).astype(object)
                    number[c] += len(rows)
                for c in np.unique(label[label >= 0]):
                    total[c] += points[label == c].sum(0).astype(object)
                    number[c] += int((label == c).sum())
        found = []
        for c in np.flatnonzero(number):
            found.append((c, -1, 0, int(number[c])))
            for i, v in enumerate(total[c]):
                sign, rest, limb = (-1 if v < 0 else 1), abs(int(v)), 0
                while rest:
                    found.append((c, i, limb, sign * (rest % LIMB)))
                    rest, limb = rest // LIMB, limb + 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "i", "limb", "value"])

    return run


def _assigned(centroids: list[list[int]], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                points, tree = _opened(batch, at, dim)
                label, distance, _, _ = nearest(points, tree, _array(centroids), False)
                fits = [int(d) if d < 1 << 63 else None for d in distance]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[at].values, pa.array(label, pa.int32()), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int) -> list[list[int]]:
    """Integers of the k vectors with the smallest sha256 of ``1:<vec_id>``, in that order."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = rows.withColumn("_name", name).orderBy("_name", "vector").limit(k).collect()  # k rows
    return [[int(v) for v in grid(np.array([r["vector"]], np.float64))[0]] for r in chosen]


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector, after the rounds and a last assignment.

    A centroid becomes the exact floor of its vectors' mean by component; one without vectors stays. Ties go to the smaller number.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    c = F.col(f"`{vector}`")
    rows = vectors.where(usable(c, dim)).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), c.cast("array<double>").alias("vector"))
    centroids = first_centroids(rows, k)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], schema)
    blocks = written(rows.mapInArrow(_blocks(dim, block), BLOCKS), "vector-blocks")
    for _ in range(rounds):
        parts = blocks.mapInArrow(_sums(centroids, dim), "cluster int, i int, limb int, value long")
        sums: dict[int, dict[int, int]] = {}
        for r in parts.groupBy("cluster", "i", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # k x dim numbers, in limbs
            held = sums.setdefault(r["cluster"], {})
            held[r["i"]] = held.get(r["i"], 0) + int(r["value"]) * LIMB ** r["limb"]
        for j, held in sums.items():
            centroids[j] = [held.get(i, 0) // held[-1] for i in range(dim)]
    assigned = cut(blocks.mapInArrow(_assigned(centroids, dim), "vec_id long, cluster int, distance long"))
    # a distance that no long holds leaves the sums of its cluster and of all without a value
    found = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()  # at most k rows
    fits = lambda rows: int(sum(r["d"] for r in rows)) if all(r["n"] == r["known"] for r in rows) and sum(r["d"] for r in rows) < 1 << 63 else None
    digest = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    facts = spark.createDataFrame([(r["cluster"], fits([r]), fits(found), digest(r["cluster"])) for r in found], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

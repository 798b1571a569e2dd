"""Whitening by LOBPCG: the leading eigenvectors of the covariance from block products over rows, never the covariance itself.

A pass computes V B for a block B of a few columns: each task sums C^T (C B) over its centred rows C, the sums are added by
Spark (one number for each row and column of the block), and d x m numbers reach the driver. A round takes the residuals of the
iterate, makes them orthogonal to what is there, multiplies them in one pass, and solves the Rayleigh-Ritz problem on the iterate,
the residuals and the previous directions; the products of the others follow from those known. The iterate has some columns
more than components are asked for, so that close eigenvalues after the last one don't slow it. At the end V X is computed
anew, and the rounds go on until the residuals of that product are below ``tolerance`` times the largest eigenvalue.

Entries are integers floor(scale * c) + offset, c as double. Sums are exact; a row is centred as (n * x - S) / n, which is exact
before the division. Left out: vectors that are null or hold null or non-finite entries, and those whose length isn't the most
frequent one (of equally frequent lengths the greatest). Components with an eigenvalue below 1e-12 of the greatest have no
direction to be whitened and aren't returned; equal vectors, or a single one, give no rows. A deviation that no long holds is
null. Rows that repeat count as often as they are there; a null id stays null.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.centroids import matrix, usable
from tessellar.llm.common import small_batches

COMPONENTS = 8
GUARD = 8
SCALE, OFFSET = 1024, 100_000
TOLERANCE = 1e-13
ROUNDS = 200
LEAST = 1e-12
#: Integers up to this size are exact in doubles.
EXACT = 1 << 53


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one column a component
    trace: float
    residual: float  # largest norm of V x - e x over the largest eigenvalue
    rounds: int


def integers(x: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """floor(scale * x) + offset as int64, or as Python's integers where one is too large."""
    y = np.floor(float(scale) * x)
    if not y.size or np.abs(y).max() < EXACT - offset:
        return y.astype(np.int64) + offset
    return np.array([[(int(v) if np.isfinite(v) else int(w) * scale) + offset for v, w in zip(r, q, strict=True)] for r, q in zip(y, x, strict=True)], object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    most = max(abs(v) for v in sums) + n * max(1, int(np.abs(x).max())) if x.size else 0
    return n * x - np.array(sums, np.int64) if x.dtype != object and most < 1 << 62 else n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    d = deviations(x, n, sums)
    return d.astype(np.float64) / n if d.dtype != object else np.array([[v / n for v in r] for r in d])


def _totals(names: str, values: dict[tuple, float], exact: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in values], pa.int32()), pa.array([k[1] for k in values], pa.int32()), pa.array(list(values.values()), pa.int64() if exact else pa.float64())], names=names.split())


LIMB = 1 << 60


def _sums(dim: int, scale: int, offset: int):
    """A task's exact sums: (component, limb of 2^60, value); the number of rows is at component -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros(dim, object), 0
        for batch in batches:
            x = integers(matrix(batch.column("vector"), dim), scale, offset)
            if len(x):
                total += x.sum(0).astype(object) if x.dtype == object or np.abs(x).max() < (1 << 62) // len(x) else x.astype(object).sum(0)
                number += len(x)
        if number:
            found = {(-1, 0): number}
            for i, v in enumerate(total):
                sign, rest, limb = (-1 if v < 0 else 1), abs(int(v)), 0
                while rest:
                    found[i, limb] = sign * (rest % LIMB)
                    rest, limb = rest // LIMB, limb + 1
            yield _totals("i limb value", found, True)

    return run


def _products(block: np.ndarray, n: int, sums: list[int], scale: int, offset: int):
    """A task's C^T (C B) over its centred rows, and at column -1 the squares of its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, m = block.shape
        total, squares, seen = np.zeros((dim, m)), np.zeros(dim), False
        for batch in batches:
            if batch.num_rows:
                c = centred(integers(matrix(batch.column("vector"), dim), scale, offset), n, sums)
                total += c.T @ (c @ block)
                squares += (c * c).sum(0)
                seen = True
        if seen:
            values = {(i, j): total[i, j] for i in range(dim) for j in range(m)} | {(i, -1): squares[i] for i in range(dim)}
            yield _totals("i j value", values, False)

    return run


def _product(rows: DataFrame, block: np.ndarray, n: int, sums: list[int], scale: int, offset: int) -> tuple[np.ndarray, float]:
    """V B and the trace of V, by one pass over the rows."""
    parts = rows.mapInArrow(_products(block, n, sums, scale, offset), "i int, j int, value double")
    out, trace = np.zeros(block.shape), 0.0
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # d x (m + 1) numbers
        if r["j"] < 0:
            trace += r["value"]
        else:
            out[r["i"], r["j"]] = r["value"]
    return out / n, trace / n


def _orthonormal(block: np.ndarray, against: np.ndarray | None) -> np.ndarray:
    """A basis of what the block adds to an orthonormal one; columns that add nothing go."""
    for _ in range(2):
        if against is not None and against.size:
            block = block - against @ (against.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 1e-300] / norms[norms > 1e-300]
        if not block.shape[1]:
            return block
        q, s, _ = np.linalg.svd(block, full_matrices=False)
        block = q[:, s > 1e-10 * s.max()]
    return block


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS, guard: int = GUARD, scale: int = SCALE, offset: int = OFFSET, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> Whitening | None:
    """Leading eigenpairs of the covariance of the rows' integers (column ``vector``); None without rows.

    The start block is drawn from a fixed seed. A warning says if the residuals don't fall below the tolerance.
    """
    sums, n = [0] * dim, 0
    for r in rows.mapInArrow(_sums(dim, scale, offset), "i int, limb int, value long").groupBy("i", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # d numbers, in limbs
        if r["i"] < 0:
            n = int(r["value"])
        else:
            sums[r["i"]] += int(r["value"]) * LIMB ** r["limb"]
    if not n:
        return None
    times = lambda block: _product(rows, block, n, sums, scale, offset)
    m = min(dim, components + guard)
    x = _orthonormal(np.random.default_rng(7).standard_normal((dim, m)), None)
    vx, trace = times(x)
    p, vp, best = np.zeros((dim, 0)), np.zeros((dim, 0)), np.inf
    done, fresh, stalled = 0, True, 0
    while True:
        h = x.T @ vx
        values, turn = np.linalg.eigh((h + h.T) / 2)
        x, vx, values = x @ turn[:, ::-1], vx @ turn[:, ::-1], values[::-1]
        residuals = vx - x * values
        asked = min(components, m)
        worst = float(np.linalg.norm(residuals[:, :asked], axis=0).max() / values[0]) if values[0] > 0 else 0.0
        if worst <= tolerance or done >= rounds or stalled > 2:
            if fresh:
                break
            x = _orthonormal(x, None)  # certify: the product of the iterate itself
            (vx, _), fresh, p, vp = times(x), True, np.zeros((dim, 0)), np.zeros((dim, 0))
            continue
        stalled = stalled + 1 if worst >= best / 2 and worst < 1e-10 else 0
        best = min(best, worst)
        w = _orthonormal(residuals, np.hstack([x, p]))
        vw = times(w)[0] if w.shape[1] else w
        done, fresh = done + 1, False
        basis, images = np.hstack([x, p, w]), np.hstack([vx, vp, vw])
        h = basis.T @ images
        _, turn = np.linalg.eigh((h + h.T) / 2)
        turn = turn[:, ::-1][:, :m]
        rest = np.vstack([np.zeros((m, m)), turn[m:]])  # the part of the new iterate outside the old one is the next direction
        rest = _orthonormal(rest - turn @ (turn.T @ rest), turn)
        x, vx, p, vp = basis @ turn, images @ turn, basis @ rest, images @ rest
    if worst > max(tolerance, 1e-10):
        warnings.warn(f"after {done} rounds the residuals are {worst:.2g} of the largest eigenvalue", stacklevel=2)
    keep = [j for j in range(min(components, m)) if values[j] > LEAST * max(values[0], 0) and values[j] > 0]
    vectors = x[:, keep]
    if keep:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(keep))] < 0, -1.0, 1.0)
    return Whitening(n, sums, values[keep], vectors, trace, worst, done)


def _projected(model: Whitening, scale: int, offset: int, moments: bool):
    """Projections over the roots of the eigenvalues: rows (vec_id, deviation, whitened), or a task's sums of z and of z z^T."""
    dim, k = model.vectors.shape
    ways = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, k + 1)), False
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(matrix(batch.column("vector"), dim), scale, offset)
            z = centred(x, model.n, model.sums) @ ways
            if moments:
                total += np.hstack([z.T @ z, z.sum(0)[:, None]])
                seen = True
                continue
            d = deviations(x, model.n, model.sums)
            small = d.dtype != object and int(np.abs(d).max()) ** 2 * dim < 1 << 63
            square = ((d if small else d.astype(object)) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([int(v) if v < 1 << 63 else None for v in square], pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], names=["vec_id", "deviation", "z"])
        if seen:
            yield _totals("i j value", {(i, j): total[i, j] for i in range(k) for j in range(k + 1)}, False)

    return run


def identity_error(rows: DataFrame, model: Whitening, scale: int = SCALE, offset: int = OFFSET) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(model.values)
    held = np.zeros((k, k + 1))
    for r in rows.mapInArrow(_projected(model, scale, offset, True), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # k x (k + 1) numbers
        held[r["i"], r["j"]] = r["value"]
    mean = held[:, k] / model.n
    return float(np.abs(held[:, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, **options: float) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and component, numbered from 1 by falling eigenvalue."""
    spark = vectors.sparkSession
    small_batches(spark)
    c = F.col(f"`{vector}`")
    rows = vectors.where(usable(c)).select(F.col(f"`{vec_id}`").alias("vec_id"), c.cast("array<double>").alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = lengths[0]["length"] if lengths else 0
    kind = vectors.select(f"`{vec_id}`").dtypes[0][1]
    rows = rows.where(F.size("vector") == dim)
    model = fit(rows, dim, components, scale=scale, offset=offset, **options) if dim else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"vec_id {kind}, {schema}")
    error = identity_error(rows, model, scale, offset)
    explained = F.element_at(F.array(*[F.lit(float(v / model.trace)) for v in model.values]), F.col("component"))
    found = rows.mapInArrow(_projected(model, scale, offset, False), f"vec_id {kind}, deviation long, z array<double>")
    found = found.select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened")).withColumn("component", F.col("k") + 1)
    return found.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))

import math

import numpy as np
import pytest

from tessellar.llm import whitening
from tessellar.llm.queries import op13_embedding_whitening


def plain(x, components=8):
    """Eigenvectors of the whole covariance, by numpy."""
    n = len(x)
    c = (n * x - x.sum(0)) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return c @ vectors[:, :components] / np.sqrt(values[:components]), values


def same(df, ids, x, components=8, tolerance=1e-9):
    got = df.toPandas()
    want, values = plain(x, components)
    assert len(got) == len(ids) * components and set(got["component"]) == set(range(1, components + 1))
    deviation = ((len(x) * x.astype(object) - x.astype(object).sum(0)) ** 2).sum(1)
    for j in range(components):
        some = got[got["component"] == j + 1].set_index("vec_id").loc[ids]
        z = some["whitened"].to_numpy()
        assert min(np.abs(z - want[:, j]).max(), np.abs(z + want[:, j]).max()) < tolerance
        assert np.allclose(some["explained"], values[j] / values.sum(), rtol=1e-9)
        assert list(some["deviation"]) == list(deviation)
    assert (got["n"] == len(x)).all() and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_query_against_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r["embedding"] for r in rows], float)).astype(np.int64) + 100_000
    same(op13_embedding_whitening(spark, sf), [r["vec_id"] for r in rows], x)


def test_many_dimensions_take_rounds_and_certify(spark):
    """More dimensions than the search space holds, close eigenvalues after the last component."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 150)) * np.linspace(3, 1, 150)
    df = spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    y = np.floor(1024 * x).astype(np.int64) + 100_000
    same(whitening.whiten(df, components=5), list(range(600)), y, 5)
    from pyspark.sql import functions as F

    model = whitening.fit(df.select(F.col("embedding").alias("vector")), 150, 5)
    assert model.rounds > 2 and model.residual <= whitening.TOLERANCE
    with pytest.warns(UserWarning, match="residuals"):
        assert whitening.fit(df.select(F.col("embedding").alias("vector")), 150, 5, rounds=1).residual > 1e-6


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 3))
    good = [(k, list(map(float, r))) for k, r in enumerate(x)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [math.nan, 1.0, 1.0]), (104, [1.0, -math.inf, 1.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 2) for r in good + bad], "vec_id long, embedding array<double>, component string, z int")
    y = np.floor(1024 * x).astype(np.int64) + 100_000
    same(whitening.whiten(df), list(range(40)), y, 3)
    again = whitening.whiten(df.unionByName(df))
    assert again.count() == 2 * 40 * 3 and again.first()["n"] == 80
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 3")).count() == 0  # one vector has no direction
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(8)], "vec_id long, embedding array<double>")
    assert whitening.whiten(flat).count() == 8  # rank 1: one component
    nameless = whitening.whiten(spark.createDataFrame([(None, [float(k % 5), float(k * k)]) for k in range(9)], "vec_id string, embedding array<double>"))
    assert nameless.count() == 18 and nameless.first()["vec_id"] is None


def test_sizes_beyond_a_long(spark):
    df = spark.createDataFrame([(k, [1e30 * k, 7.0 * k * k, -1e5]) for k in range(12)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert got and all(r["deviation"] is None or r["deviation"] >= 0 for r in got) and got[0]["identity_error"] < 1e-4

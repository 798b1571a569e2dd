import numpy as np
from pyspark.sql import functions as F

from tessellar.llm import mixing


def test_raking_meets_the_margins_and_agrees_with_numpy(spark):
    t = np.array([[40.0, 10, 5], [3, 70, 9], [8, 2, 100]])
    rows = [(f"s{i}", f"l{j}", int(t[i, j])) for i in range(3) for j in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, tokens long")
    goals = {"source": [0.5, 0.3, 0.2], "lang": [0.2, 0.3, 0.5]}
    targets = {n: spark.createDataFrame([(f"{n[0]}{k}", s) for k, s in enumerate(v)] + [("absent", 9.0)], "value string, share double") for n, v in goals.items()}
    for few, rounds in ((20_000, 40), (-1, 3)):
        want = t.copy()
        for _ in range(rounds):
            want *= (np.array(goals["source"]) * t.sum() / want.sum(1))[:, None]
            want *= np.array(goals["lang"]) * t.sum() / want.sum(0)
        mixing.FEW_CELLS, held = few, mixing.FEW_CELLS
        try:
            raked = mixing.rake(cells, targets, rounds=rounds, tolerance=1e-15)
            got = {(r["source"], r["lang"]): r["raked"] for r in raked.collect()}
        finally:
            mixing.FEW_CELLS = held
        assert all(abs(got[f"s{i}", f"l{j}"] - want[i, j]) < 1e-6 for i in range(3) for j in range(3))
    scale = mixing.scale_for(raked, 0.6)
    spent = sum(min(1, scale * got[s, g] / n) * n for s, g, n in rows)
    assert abs(spent - 0.6 * t.sum()) < 1e-6


def test_odd_rows(spark):
    rows = [(1, "a b c", "x", "en", 9), (1, "a b c", "x", "en", 9), (2, None, None, "en", 9), (None, "", "x", None, 9), (3, "w " * 50_000, "y", "fr", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight int")
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    out = mixing.mix(docs, dims, mixing.n_tokens(F.col("text")))
    assert out.columns == ["doc_id", "text", "source", "lang", "n_tokens", "probability", "weight", "sampled"]
    got = out.collect()
    assert len(got) == 5 and all(0 <= r["probability"] <= 1 for r in got)
    assert {r["n_tokens"] for r in got} == {3, 0, 50_000}
    assert [r["probability"] for r in got if r["n_tokens"] == 0] == [1.0, 1.0]
    assert len({(r["probability"], r["sampled"]) for r in got if r["doc_id"] == 1}) == 1
    assert mixing.mix(docs.limit(0), dims, mixing.n_tokens(F.col("text"))).collect() == []


def test_weights_restore_the_margins(spark):
    r = np.random.default_rng(3)
    rows = [(i, "w " * int(r.integers(1, 60)), "hot" if i % 3 else f"s{i % 7}", "en" if i % 4 else "fr") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix(docs, {"source": F.col("source"), "lang": F.col("lang")}, mixing.n_tokens(F.col("text"))).toPandas()
    own = out.assign(e=out.n_tokens * out.probability * out.weight).groupby("source").e.sum()
    share, want = own / own.sum(), out.groupby("source").n_tokens.sum() ** 0.7
    assert np.allclose(share, want / want.sum(), atol=1e-6)
    assert abs((out.n_tokens * out.probability).sum() / out.n_tokens.sum() - 0.8) < 1e-9

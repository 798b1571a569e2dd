import numpy as np

from tessellar.llm import quality
from tessellar.llm.common import crc_mod, text_buffers
from tessellar.llm.queries import op10_quality, table
from pyspark.sql import functions as F
import pyarrow as pa

SF = "/root/testdata/sf0.01"


def test_prior_of_a_known_mixture():
    r = np.random.default_rng(0)
    p = r.normal(3, 1, 2000)
    u = np.concatenate([r.normal(3, 1, 1400), r.normal(-3, 1, 600)])
    assert abs(quality.estimate_prior(p, u) - 0.7) < 0.05


def test_risk_separates_without_negative_labels():
    r = np.random.default_rng(1)
    good, bad = r.normal(1, 0.5, (900, 3)), r.normal(-1, 0.5, (300, 3))
    w, b = quality.fit_nnpu(good[:400], np.concatenate([good[400:], bad]), 500 / 800)
    assert ((good @ w + b) > 0).mean() > 0.97 and ((bad @ w + b) < 0).mean() > 0.93


def test_held_out_accuracy(spark):
    got = op10_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    pos, neg = (got[got.quality == q].score.to_numpy() for q in (1, 0))
    assert (pos[:, None] > neg[None]).mean() > 0.97
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_scores_depend_on_the_text_alone():
    texts = ["", "Some words here.", "A " * 50_000, "Some words here.", "$$$ ***"]
    x = quality.features(*text_buffers(pa.array(texts)))
    model = quality.fit_model(x[[1, 2]], x[[3, 4]])
    together = model.score(x)
    alone = [float(model.score(quality.features(*text_buffers(pa.array([t]))))[0]) for t in texts]
    assert together.tolist() == alone and together[1] == together[3]


def test_odd_rows_and_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None, "a", 5.0), (None, "", "b", 6.0), (1, "text", None, 7.0), (1, "text", None, 7.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, crc_mod(F.col("doc_id"), 4) != 99)
    out = quality.score_quality(docs, model)
    assert out.columns == ["doc_id", "text", "source", "score", "predicted"]
    assert [r["score"] for r in out.collect()] == [0.5] * 4
    assert quality.score_quality(docs.limit(0), quality.train(docs.limit(0), labels.limit(0), F.lit(True))).collect() == []


def test_features_equal_a_plain_count():
    texts = ["The cat the cat sat, 12 times!", "", "Ünï $5 $5\n\n| a | a |", "x", "w " * 500]
    got = quality.features(*text_buffers(pa.array(texts)))
    kinds = {ord(c): k for k, signs in enumerate(quality.SIGNS) for c in signs}
    for row, text in zip(got, texts, strict=True):
        raw = text.encode()
        n = len(quality.SIGNS)
        kind = [kinds.get(b, n if 97 <= b < 123 else n + 1 if 65 <= b < 91 else n + 2 if 48 <= b < 58 else n + 3 if 128 <= b < 192 else n + 4 if b >= 192 else n + 5) for b in raw]
        want = np.zeros(quality.N_FEATURES)
        for k in kind:
            want[k] += 1 / len(raw)
        for a, b in zip(kind, kind[1:]):
            want[quality.N_CLASSES + a * quality.N_CLASSES + b] += 1 / len(raw)
        words = text.lower().split()
        for k in (1, 2):
            want[quality.N_FEATURES - 3 + k] = sum(a == b for a, b in zip(words, words[k:])) / max(1, len(words))
        assert np.allclose(row[:-1], np.sqrt(want), atol=1e-5) and abs(row[-1] - len(raw) / (len(raw) + quality.SMOOTHING)) < 1e-6


def plain_risk(w, xp, xu, prior, decay):
    """The non-negative risk, row by row."""
    loss = lambda z: np.log1p(np.exp(-z))
    z = lambda x: float(x @ w[:-1] + w[-1])
    positive = sum(loss(z(x)) for x in xp) / len(xp)
    negative = sum(loss(-z(x)) for x in xu) / len(xu) - prior * sum(loss(-z(x)) for x in xp) / len(xp)
    return prior * positive + max(0.0, negative) + decay / 2 * float(w[:-1] @ w[:-1]), negative


def test_the_fit_has_the_least_risk_of_its_neighbours():
    r = np.random.default_rng(5)
    xp, xu = r.normal(0.5, 1, (60, 3)), np.concatenate([r.normal(0.5, 1, (50, 3)), r.normal(-0.5, 1, (70, 3))])
    prior, decay = 50 / 120, 1e-2
    w, bias = quality.fit_nnpu(xp, xu, prior, steps=4000, decay=decay)
    at = np.append(w, bias)
    risk, negative = plain_risk(at, xp, xu, prior, decay)
    assert negative > 0
    slope = [(plain_risk(at + e, xp, xu, prior, decay)[0] - plain_risk(at - e, xp, xu, prior, decay)[0]) / 2e-4 for e in np.eye(4) * 1e-4]
    assert np.abs(slope).max() < 5e-3
    for _ in range(30):
        assert plain_risk(at + r.normal(0, 0.3, 4), xp, xu, prior, decay)[0] > risk


def test_scores_are_those_of_the_formula():
    r = np.random.default_rng(6)
    x = quality.features(*text_buffers(pa.array(["some words here", "SPAM!!! $$$ buy buy", "other plain words of a text", "###"])))
    model = quality.QualityModel(r.normal(size=quality.N_FEATURES), r.random(quality.N_FEATURES) + 0.1, r.normal(size=quality.N_FEATURES), 0.3, 0.5)
    for row, score in zip(x, model.score(x), strict=True):
        z = 0.3 + sum((float(v) - m) / s * float(row[-1]) * w for v, m, s, w in zip(row[:-1], model.mean, model.spread, model.weights, strict=True))
        assert abs(score - 1 / (1 + np.exp(-max(-30, min(30, z))))) < 1e-6

"""Quality by positive-unlabelled learning: a linear model of character-class statistics under the non-negative risk.

The trusted positives are rows labelled 1; the unlabelled texts are rows of the corpus whatever their label. The share of
good texts among the unlabelled (the class prior) is estimated first, by best-bin estimation: of a classifier that
tells positives from unlabelled, take the threshold where the ratio of the two tails is surely least. Then the model
minimises  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))  with the logistic loss (Kiryo et al.,
2017); its sigmoid is the score.

Features are counts only: square roots of the shares of character classes, of pairs of neighbouring classes, and of
words that repeat the word one or two before. They count in full for long texts only: what a text of n bytes shows is
weighed by n / (n + 64), so a few words say little for or against it.
Samples are bounded (``positives``, ``unlabelled``); every text is scored whole, in the task that read it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tessellar.llm.common import by_bytes, small_batches, text_buffers
from tessellar.llm.sampling import sampled
from tessellar.llm.words import find_words, space_words

POSITIVES = 4000
UNLABELLED = 6000
THRESHOLD = 0.7
CHUNK_BYTES = 500_000

#: The classes of characters beside letters, digits and bytes beyond ASCII; all other bytes make one more class.
SIGNS = (" ", "\n", "\t\r", ".", ",", ";:", "!", "?", "'\"`", "|", "*", "$", "%", "&", "#", "()[]{}<>", "/\\", "-", "_", "@", "=+~^")
N_CLASSES = len(SIGNS) + 6
N_FEATURES = N_CLASSES + N_CLASSES**2 + 2
SMOOTHING = 64


def _classes() -> np.ndarray:
    table = np.full(256, N_CLASSES - 1, np.int64)
    for k, signs in enumerate(SIGNS):
        table[[ord(c) for c in signs]] = k
    for k, bounds in enumerate(((0x61, 0x7B), (0x41, 0x5B), (0x30, 0x3A), (0x80, 0xC0), (0xC0, 0x100)), len(SIGNS)):
        table[bounds[0] : bounds[1]] = k
    return table


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text of the buffer, the weight of its size last; a text without bytes has zeros."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    kind = _classes()[data]
    text = np.repeat(np.arange(n), sizes)
    single = np.bincount(text * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    same = text[1:] == text[:-1]
    pair = (text[:-1] * N_CLASSES**2 + kind[:-1] * N_CLASSES + kind[1:])[same]
    double = np.bincount(pair, minlength=n * N_CLASSES**2).reshape(n, N_CLASSES**2)
    size = np.maximum(sizes, 1)[:, None]
    words = find_words(data, offsets, space_words())
    owner, count = np.repeat(np.arange(n), words.counts), np.maximum(words.counts, 1)[:, None]
    again = [np.bincount(owner[k:][(words.hashes[k:] == words.hashes[:-k]) & (owner[k:] == owner[:-k])], minlength=n)[:, None] / count for k in (1, 2)]
    return np.concatenate([np.sqrt(np.concatenate([single / size, double / size, *again], axis=1)), (sizes / (sizes + SMOOTHING))[:, None]], axis=1).astype(np.float32)


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Features in units of their spread, in the precision of the rows."""
        return (x[:, :-1] - self.mean.astype(x.dtype)) / self.spread.astype(x.dtype) * x[:, -1:]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good text; it depends on the row alone, not on the batch around it."""
        return _sigmoid((self.standard(x.astype(np.float64)) * self.weights).sum(axis=1) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g * g
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def tell_apart(a: np.ndarray, b: np.ndarray, steps: int = 200, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model of rows a (1) against rows b (0), both classes of equal weight."""
    w, adam = np.zeros(a.shape[1]), _Adam(a.shape[1], 0.05)
    for _ in range(steps):
        own = w.astype(a.dtype)
        w = adam.step(w, (_sigmoid(b @ own) @ b / len(b) - _sigmoid(-(a @ own)) @ a / len(a)) / 2 + decay * w)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from the scores of a classifier of positives against unlabelled."""
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(p)
    above_p = 1 - np.searchsorted(p, at, "left") / len(p)
    above_u = 1 - np.searchsorted(u, at, "left") / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(u)) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    k = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[k] / above_p[k], 0.01, 0.99))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 500, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; where the negative part falls below 0 the step goes back on it."""
    xp, xu = positive, unlabelled
    w, adam = np.zeros(xp.shape[1] + 1), _Adam(xp.shape[1] + 1, 0.05)
    loss = lambda z: np.logaddexp(0, -z)
    slope = lambda x, g: np.append(g.astype(x.dtype) @ x, g.sum()) / len(x)
    for _ in range(steps):
        own = w[:-1].astype(xp.dtype)
        zp, zu = xp @ own + w[-1], xu @ own + w[-1]
        negative_risk = loss(-zu).mean() - prior * loss(-zp).mean()
        negative_slope = slope(xu, _sigmoid(zu)) - prior * slope(xp, _sigmoid(zp))
        g = prior * slope(xp, -_sigmoid(-zp)) + negative_slope if negative_risk >= 0 else -negative_slope
        penalty = decay * w
        penalty[-1] = 0
        w = adam.step(w, g + penalty)
    return w[:-1], float(w[-1])


def fit_model(positive: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    """The model of feature rows; without positives or unlabelled rows every text scores 0.5."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5)
    parts, n = (positive[:, :-1], unlabelled[:, :-1]), len(positive) + len(unlabelled)
    mean = sum(p.sum(axis=0, dtype=np.float64) for p in parts) / n
    square = sum(np.einsum("ij,ij->j", p, p, dtype=np.float64) for p in parts) / n
    model = QualityModel(mean, np.sqrt(np.maximum(square - mean**2, 0)) + 0.02, np.zeros(N_FEATURES), 0.0, 0.5)
    xp, xu = model.standard(positive), model.standard(unlabelled)
    scores_p, scores_u = np.zeros(len(xp)), np.zeros(len(xu))
    for k in range(2):  # scores of rows that their own classifier hasn't seen
        own_p, own_u = np.arange(len(xp)) % 2 == k, np.arange(len(xu)) % 2 == k
        if not own_p.all() and not own_u.all():
            w = tell_apart(xp[~own_p], xu[~own_u])
            scores_p[own_p], scores_u[own_u] = xp[own_p] @ w, xu[own_u] @ w
    model.prior = estimate_prior(scores_p, scores_u)
    model.weights, model.bias = fit_nnpu(xp, xu, model.prior)
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", CHUNK_BYTES):
        x = features(*text_buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("positive"), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "positive", "x"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the sample as one row; the order in which rows come doesn't matter."""
    got = sorted(((p, x) for b in batches for p, x in zip(b.column("positive").to_pylist(), b.column("x").to_pylist(), strict=True)), reverse=True)
    if not got:
        return
    x = {p: np.frombuffer(b"".join(b for q, b in got if q is p), np.float32).reshape(-1, N_FEATURES + 1) for p in (True, False)}
    del got
    mixed = np.random.default_rng(0)
    m = fit_model(mixed.permutation(x.pop(True)), mixed.permutation(x.pop(False)))
    vectors = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (m.mean, m.spread, m.weights)]
    yield pa.RecordBatch.from_arrays([*vectors, pa.array([float(m.bias)]), pa.array([float(m.prior)])], ["mean", "spread", "weights", "bias", "prior"])


def train(docs: DataFrame, labels: DataFrame, learnable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel:
    """Learns from at most twice ``positives`` rows labelled 1 and twice ``unlabelled`` others; ``learnable`` (of the id column) rules rows out.

    Labels of null ids, null labels and contradicting labels of one id are left out; null texts are no training rows.
    """
    small_batches(docs.sparkSession)
    own = labels.where(learnable).where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull())
    good = own.groupBy(F.col(f"`{doc_id}`").alias("_key")).agg(F.min(F.col(f"`{label}`")).alias("_least")).where("_least = 1").select("_key")
    good = sampled(good, F.col("_key"), positives)
    rows = docs.where(learnable).where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("key"), F.col(f"`{text}`").alias("text"))
    trusted = rows.join(F.broadcast(good), rows["key"] == good["_key"], "left_semi").withColumn("positive", F.lit(True))  # at most 2 * positives ids
    web = sampled(rows, F.col("key"), unlabelled).withColumn("positive", F.lit(False))
    # a copied id may bring more rows than ids: the same bound again, in an order, so a task that runs again finds the same
    found = trusted.orderBy("key", F.xxhash64("text"), "text").limit(2 * positives).unionByName(web).mapInArrow(_featured, StructType([StructField("key", rows.schema["key"].dataType), *StructType.fromDDL("positive boolean, x binary")]))
    # the bounded sample meets in one task; only the model's numbers come to the driver
    row = found.select("positive", "x").repartition(1).mapInArrow(_fitted, "mean array<double>, spread array<double>, weights array<double>, bias double, prior double").first()
    if row is None:
        return fit_model(np.zeros((0, N_FEATURES + 1), np.float32), np.zeros((0, N_FEATURES + 1), np.float32))
    return QualityModel(np.array(row["mean"]), np.array(row["spread"]), np.array(row["weights"]), row["bias"], row["prior"])


def _scored(text: str, model: QualityModel, schema: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(schema)
        for batch in by_bytes(batches, text, CHUNK_BYTES):
            score = pa.array(model.score(features(*text_buffers(batch.column(text)))), pa.float64())
            carried = [batch.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*carried, score], out_schema, strict=True)], schema=out_schema)

    return run


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from the threshold on) to every row.

    Null and empty texts get the score of a text without characters; equal texts get equal scores. Columns score and
    predicted of the input are replaced. ``carry`` names the input columns to return, all of them if None.
    """
    small_batches(docs.sparkSession)
    carried = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]
    keep = carried if text in carried else [*carried, text]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)])
    schema = StructType([*inner.schema.fields[: len(carried)], StructField("_score", DoubleType())])
    out = inner.mapInArrow(_scored(f"_c{keep.index(text)}", model, schema), schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)], F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))

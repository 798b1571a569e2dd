"""Language identification with a string kernel: blended-spectrum presence, Nyström landmarks, kernel ridge regression.

A text's spectrum is the set of its byte n-grams of lengths 1 to 3 (letters with case folded, everything else a blank).
The kernel of two texts is the number of n-grams present in both over the root of the product of their numbers.
Landmark texts give the Nyström map K(x, landmarks) K(landmarks, landmarks)^(-1/2); ridge regression of one language
against the rest is solved in that space. Texts are scored in batches: presence matrix times landmark matrix times
weights.

N-grams that no landmark has can't meet one, so the presence matrix has the landmarks' n-grams only, block by block; the
sizes of the sets count all n-grams. The training sample is bounded (``sample`` rows, shared evenly among languages); whole
texts are used there and in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessellar.llm.common import by_bytes, small_batches, text_buffers
from tessellar.llm.sampling import sampled

SAMPLE = 1200
LANDMARKS = 200
RIDGE = 1e-2
UNKNOWN = "und"
LONGEST = 3
CHUNK_BYTES = 2_000_000
CHUNK_ROWS = 512
#: N-grams of a block of the presence and landmark matrices.
WIDTH = 1 << 14


def folded(data: np.ndarray) -> np.ndarray:
    """Letters of ASCII and Latin-1 in lower case; ASCII that is no letter becomes a blank."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    out = table[data]
    if len(out) > 1:
        second = out[1:]
        second[(out[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 32
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams and the text of each; a code holds the length above its bytes."""
    data = folded(data).astype(np.int32)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    codes, texts, code = [], [], np.zeros(len(data), np.int32)
    for n in range(1, LONGEST + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        code = (code[:m] << 8) | data[n - 1 :]
        whole = text[:m] == text[n - 1 :]
        codes.append(code[whole] | np.int32(n << 24))
        texts.append(text[:m][whole])
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(codes), np.concatenate(texts)


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and texts of the distinct n-grams of each text, by text and code."""
    codes, texts = grams(data, offsets)
    both = np.sort((texts.astype(np.int64) << 32) | codes)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return (both & 0xFFFFFFFF).astype(np.int32), (both >> 32).astype(np.int32)


@dataclass
class LanguageModel:
    """vocabulary: sorted codes of the landmarks' n-grams; starts and owners: the landmarks that have each; scale: one over the root of a landmark's size; weights: from kernel values to languages."""

    languages: list[str]
    vocabulary: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def kernel_of(self, codes: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
        """Kernel values with the landmarks of n texts, given by their distinct codes.

        Presence and landmark matrices are made for so many n-grams at a time, and only for those that some text has.
        """
        size = np.bincount(texts, minlength=n)
        at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == codes
        at, texts = at[known], texts[known]
        if len(self.vocabulary) > WIDTH:
            order = np.argsort(at, kind="stable")
            at, texts = at[order], texts[order]
        shared = np.zeros((n, len(self.scale)))
        for first in range(0, len(self.vocabulary), WIDTH):
            last = min(first + WIDTH, len(self.vocabulary))
            some = slice(*np.searchsorted(at, [first, last])) if len(self.vocabulary) > WIDTH else slice(None)
            if not len(at[some]):
                continue
            here = slice(self.starts[first], self.starts[last])
            marks = np.zeros((len(self.scale), last - first), np.float32)
            marks[self.owners[here], np.repeat(np.arange(last - first), np.diff(self.starts[first : last + 1]))] = 1
            for row in range(0, n, CHUNK_ROWS):
                mine = (texts[some] >= row) & (texts[some] < row + CHUNK_ROWS) if n > CHUNK_ROWS else slice(None)
                presence = np.zeros((min(CHUNK_ROWS, n - row), last - first), np.float32)
                presence[texts[some][mine] - row, at[some][mine] - first] = 1
                shared[row : row + CHUNK_ROWS] += presence @ marks.T
        return shared * self.scale / np.sqrt(np.maximum(size, 1))[:, None]

    def kernel(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Kernel values of the texts with the landmarks."""
        return self.kernel_of(*distinct(data, offsets), len(offsets) - 1)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.kernel(data, offsets) @ self.weights


def fit_model(spectra: list[np.ndarray], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """The model of rows given by their codes; landmarks are dealt evenly among the languages, longest spectra first.

    It holds the spectra, the landmarks' n-grams and one kernel value for each row and landmark, never a matrix of rows by n-grams.
    """
    names = sorted(set(languages))
    rank: dict[str, int] = {}
    order = []
    for k in sorted(range(len(spectra)), key=lambda k: (-len(spectra[k]), k)):
        order.append((rank.setdefault(languages[k], 0), languages[k], k))
        rank[languages[k]] += 1
    chosen = [k for *_, k in sorted(order)[:landmarks]]
    held = np.concatenate([spectra[k] for k in chosen])
    of = np.repeat(np.arange(len(chosen), dtype=np.int32), [len(spectra[k]) for k in chosen])
    by_code = np.argsort(held, kind="stable")
    vocabulary, starts = np.unique(held[by_code], return_index=True)
    scale = 1 / np.sqrt(np.array([max(len(spectra[k]), 1) for k in chosen], np.float64))
    model = LanguageModel(names, vocabulary, np.append(starts, len(held)).astype(np.int64), of[by_code], scale, np.zeros((len(chosen), len(names))))
    kernel = np.zeros((len(spectra), len(chosen)))
    for row in range(0, len(spectra), CHUNK_ROWS):
        some = spectra[row : row + CHUNK_ROWS]
        kernel[row : row + CHUNK_ROWS] = model.kernel_of(np.concatenate(some), np.repeat(np.arange(len(some), dtype=np.int32), [len(x) for x in some]), len(some))
    values, vectors = np.linalg.eigh(kernel[chosen])
    use = values > 1e-6 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])
    phi = kernel @ root
    y = np.array([[1.0 if own == name else -1.0 for name in names] for own in languages])
    w = np.linalg.solve(phi.T @ phi + ridge * len(kernel) / len(chosen) * np.eye(phi.shape[1]), phi.T @ y)
    model.weights = root @ w
    return model


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", CHUNK_BYTES):
        held, texts = distinct(*text_buffers(batch.column("text")))
        ends = np.searchsorted(texts, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([held[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["lang", "codes"])


def _fitted(landmarks: int):
    """The model of a task's rows: languages, and its arrays as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((name, codes) for batch in batches for name, codes in zip(batch.column("lang").to_pylist(), batch.column("codes").to_pylist(), strict=True))
        if got:
            m = fit_model([np.frombuffer(b, np.int32) for _, b in got], [name for name, _ in got], landmarks)
            arrays = [m.vocabulary, m.starts, m.owners, m.scale, m.weights]
            yield pa.RecordBatch.from_arrays([pa.array([m.languages]), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], MODEL_FIELDS)

    return run


MODEL_FIELDS = ["languages", "vocabulary", "starts", "owners", "scale", "weights"]


def train(docs: DataFrame, learnable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> LanguageModel | None:
    """Learns from at most twice ``sample`` rows with text and language that ``learnable`` allows; None if there are none.

    Where there are more languages than ``sample``, so many of the most frequent are learned. The bounded sample meets in
    one task; only the model comes to the driver.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(learnable).where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").rlike(r"\p{L}"))
    rows = rows.select(F.col(f"`{doc_id}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    few = sampled(rows, F.col("key"), sample, "lang").select("lang", "text")
    row = few.mapInArrow(_spectra, "lang string, codes binary").repartition(1).mapInArrow(_fitted(landmarks), "languages array<string>, " + ", ".join(f"{f} binary" for f in MODEL_FIELDS[1:])).first()
    if row is None:
        return None
    read = lambda f, kind: np.frombuffer(bytes(row[f]), kind)
    return LanguageModel(row["languages"], read("vocabulary", np.int32), read("starts", np.int64), read("owners", np.int32), read("scale", np.float64), read("weights", np.float64).reshape(-1, len(row["languages"])))


def _predicted(text: str, broadcast, schema: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema, model = to_arrow_schema(schema), broadcast.value
        for wide in by_bytes(batches, text, CHUNK_BYTES):
            for at in range(0, wide.num_rows, CHUNK_ROWS):
                batch = wide.slice(at, CHUNK_ROWS)
                column = batch.column(text)
                written = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                if model is not None and written.any():
                    z = np.round(model.margins(*text_buffers(column)), 6)
                    e = np.exp(4 * (z - z.max(axis=1, keepdims=True)))
                    scores = np.where(written, (e / e.sum(axis=1, keepdims=True)).max(axis=1), 0.0)
                    names = [model.languages[k] if w else UNKNOWN for k, w in zip(z.argmax(axis=1).tolist(), written.tolist(), strict=True)]
                columns = [*(batch.column(f.name) for f in schema.fields[:-2]), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    return run


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned. Ties go to
    the first language in text order. Columns lang_pred and score of the input are replaced. ``carry`` names the input
    columns to return, all of them if None.
    """
    small_batches(docs.sparkSession)
    carried = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    keep = carried if text in carried else [*carried, text]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)])
    schema = StructType([*inner.schema.fields[: len(carried)], StructField("_lang", StringType()), StructField("_score", DoubleType())])
    out = inner.mapInArrow(_predicted(f"_c{keep.index(text)}", docs.sparkSession.sparkContext.broadcast(model), schema), schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)], F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
